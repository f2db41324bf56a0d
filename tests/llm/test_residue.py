"""Residue: planted passages in real texts, held-out kinds, and texts that only write about such things."""

import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonolith.llm import residue
from sonolith.llm.residue import best_scores, find_residue, is_trusted, passages

PROSE = [
    "The count at {p} gives {n} vehicles a day, of which {m} % are lorries.", "Wind from the south-west blows {m} % of the time at {p}.",
    "A wall of {m} m runs along the embankment near {p}.", "Trains on the line through {p} pass at {n} km/h.",
    "Authors of these pages write {{{{place}}}} or [[place]] for a name, and the builder has replaced it before anyone reads it.",
    "Last month a visitor saw the words \"page not found\" on an old link to {p}; the link now leads on.", "Old addresses give {n} on purpose near {p}.",
]
BAD = [
    "Welcome to the noise page of <%= place %>, {p}!", "Welcome to the noise page of {{{{name}}}}, {p}!", "Please enable JavaScript to view the map.",
    '{{"error":"Not Found","status":404,"message":"The requested URL was not found on this server."}}', "Lorem ipsum dolor sit amet elit sed enim magna.",
    "Traceback (most recent call last):", "503 Service Unavailable",
]


def corpus(n=1500):
    rows, truth = [], set()
    names = ["Oakton", "Penby", "Kelham", "Norford", "Wesley"]
    for i in range(n):
        parts = [PROSE[(i + k * 3) % len(PROSE)].format(p=names[(i + k) % 5], n=100 + i, m=i % 60) for k in range(3)]
        if i % 12 == 0:
            truth.add(i)
            bad = BAD[i // 12 % len(BAD)].format(p=names[i % 5])
            parts = [bad] if i % 24 == 0 else [*parts[:1], bad, *parts[1:]]
        rows.append((i, "\n".join(parts)))
    return rows, truth


def test_found(spark):
    rows, truth = corpus()
    rows += [(9001, None), (9002, ""), (9003, " \n\t"), (9004, rows[0][1]), (9005, "x " * 100_000)]
    out = find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = {r.doc_id for r in out.where("residue").collect()}
    assert out.count() == len(rows)
    assert got == truth | {9004}


def learnt():
    found = [p for _, text in corpus()[0] for p in passages(text)]
    return residue.learn(residue._lists(found), np.array([is_trusted(p) for p in found]))


def test_heldout_wording_is_learnt():
    value, counts = best_scores(["Welcome to the noise page of null, XXX!", "The count at Oakton gives 200 vehicles a day.", None, " "], *learnt())
    assert value[0] > 0 > value[1] and np.isnan(value[2:]).all()
    assert counts.tolist() == [1, 1, 0, 0]


#: Wordings that no form of the seed has.
UNSEEN = ["To view the map, please enable JavaScript first.", "A traceback, most recent call last:", "Service Unavailable, a 503", "Welcome to the noise page of ***NAME***, Oakton!",
    "Pagina non trovata", "Segmentation fault (core dumped)"]


def test_unseen_wordings_by_the_model_alone(spark):
    rows, truth = corpus()
    rows += [(9001 + i, f"A wall of 7 m runs along the embankment near Oakton.\n{p}") for i, p in enumerate(UNSEEN)]
    assert not any(is_trusted(p) for p in UNSEEN)
    out = find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = {r.doc_id for r in out.where("residue").collect()}
    # What shares words with the trusted forms is found, what shares none (the last two) is not.
    assert got - truth == {9001, 9002, 9003, 9004} and truth <= got


def test_nothing_trusted_and_empty(spark):
    df = spark.createDataFrame([(1, "A quiet road."), (2, "Another one.")], "doc_id long, text string")
    assert find_residue(df).where("residue").count() == 0
    assert find_residue(df.limit(0)).count() == 0


FIELDS = ["{{x.y}}", "${x}", "<%= x %>", "%(x)s", "@@x@@", "__X__", "[insert the name here]", "«x»", "{% x %}", "#{x}", "[[x]]", "***X***"]


@pytest.mark.parametrize("field", FIELDS)
def test_fields_are_one_word(field):
    assert residue.marked(f"At {field} now").split() == ["At", "¤field", "now"]


def test_passages():
    assert passages("One. Two!\r\n\r\n &lt;place&gt; three") == ["One.", "Two!", "<place> three"]
    assert passages('{"error":"x"} Next one') == ['{"error":"x"}', "Next one"]
    assert residue.passages(None) == []


def plain_tokens(text):
    """The words by a loop."""
    out = []
    for w in re.findall(r"[\w¤]+|[\r\n]|[.!?…]\)?(?=\s|$)|[{}<>\"“”„:|]", text.lower()):
        ends = w[0] in "\r\n.!?…"
        out.append(0 if ends else residue._hash(re.sub(r"\d+", "0", w)))
    return [*out, 0]


@given(st.lists(st.text(alphabet="aÄßé07.!?…) \n\r<>{}:|_¤الط ", max_size=40), min_size=1, max_size=5))
def test_tokens_as_arrays_equal_a_loop(texts):
    tokens, held = residue.tokenize(texts)
    want = [plain_tokens(t) for t in texts]
    assert tokens[0] == 0
    # A full stop at the end of a text ends a passage as the end itself does.
    assert tokens[1:].tolist() == [w for x in want for w in x]
    assert held.tolist() == [x.count(0) for x in want]


def test_long_texts_are_read_in_parts(monkeypatch):
    model = learnt()
    text = "A quiet road.\n" * 50 + "503 Service Unavailable\n" + "The next road is quiet as well.\n" * 50
    whole = best_scores([text, "x", None, text], *model)
    monkeypatch.setattr(residue, "CHUNK", 60)
    parts = best_scores([text, "x", None, text], *model)
    assert np.array_equal(whole[0], parts[0], equal_nan=True) and whole[0][0] > 0
    assert whole[1].tolist() == parts[1].tolist() == [101, 1, 0, 101]


def test_the_model_alone_decides(spark):
    rows, truth = corpus()
    assert is_trusted("403 Roads counted twice near") and is_trusted("{% quiet %} wall of 3 m runs along the embankment near the server room")
    rows += [(9001, "Cerrorejo\t23721\t4.6\t40"), (9002, "Authors of these pages write {{place}} or [[place]] for a name.")]
    rows += [(9003, "The count gives {{n}} vehicles a day."), (9004, "A wall of 3 m runs along the embankment near the server room.")]
    out = find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = {r.doc_id: r for r in out.collect()}
    assert {k for k, r in found.items() if r.residue} == truth
    assert all(r.residue == (r.score is not None and r.score > 0) for r in found.values())


def test_sample_of_passages_is_a_uniform_draw(spark):
    rows = [(i, "\n".join(f"{'abcdefghij'[i % 10]}{'klmnopqrstuvwxyzabcd'[k]} road." for k in range(20))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def drawn(df):
        return sorted(map(str, residue._sample(df, "doc_id", "text", 1000, 2000).column("words").to_pylist()))

    got = drawn(df.coalesce(1))
    assert 1700 < len(got) < 2300
    assert got == drawn(df.orderBy(F.desc("doc_id")).repartition(7))
    one = drawn(df.where("doc_id % 10 = 9").union(df.where("doc_id % 10 < 9")).coalesce(1))
    assert got == one and len(set(got)) > 9
    assert residue._sample(df, "doc_id", "text", 1000, 20000).num_rows == 20000
