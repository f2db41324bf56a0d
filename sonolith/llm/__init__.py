"""Operators for texts and entities: tokens, containers, residue, fusion and matching. Nothing outside imports this."""
