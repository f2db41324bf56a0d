"""Template residue, filler, error messages and script notices in texts: positive-unlabelled naive Bayes.

A text is read in passages (lines and sentences, character references resolved). A short seed of forms (`STARTS`, `HOLDS`: field
marks that prose doesn't use, status lines and error pages, stack traces, well-known filler, script notices) makes some
passages trusted positives; all others are unlabelled. `fit` learns a naive Bayes model of words and word pairs by
expectation-maximization: trusted passages stay positive, the others get the posterior of the last round as their weight
(the positive part damped by `damping`), round by round. Unfilled fields of all kinds are one word to the model, so that
what surrounds them is learnt, and numbers are one word as well. What positives say of a feature is discounted by nearly
one passage (`discount`), so that a word which stood beside a single trusted form by chance counts for nothing.

The seed labels the fit and nothing else. Every passage, trusted or not, is scored by the model alone; a record's score
is that of its best passage, and the record is residue when that posterior is above one half. No list accepts or rejects.

The model is fitted on about `fit_documents` documents at most, drawn by a hash of their id, and of these on about
`fit_passages` passages at most, drawn by a hash of id and place (the documented bounds; under them, all passages are
used). Both draws are uniform and the same wherever the rows lie. Everything else covers every document: scoring is one
pass where the texts lie, without a shuffle, on the tokens of a whole batch as arrays; the model is one array of 8 MB,
whatever the corpus.

Defined cases: null, empty and blank texts have no passage and are none (score null); texts of any length are read
whole; repeated texts get the same answer; without a trusted passage in the sample there is no model and nothing is
found; an empty table gives no rows; extra columns of any name don't come out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 1 << 21
FIT_DOCUMENTS = 15_000
FIT_PASSAGES = 300_000
SMOOTH = 5.0
DISCOUNT = 0.9
MOST_WORDS = 12
CHUNK = 1_000_000

_FIELD = re.compile(
    r"\{\{.{1,40}?\}\}|\$\{[\w.]+\}|<%=? ?[\w.]+ ?%>|\{% ?[\w.]+ ?%\}|#\{[\w.]+\}|\[\[[\w.]+\]\]|%\([\w.]+\)s"
    r"|@@[\w.]+@@|__[\w.]+?__|%[A-Z_.]{3,}%|\$[A-Z_.]{3,}\$|\*{3}[\w.]+\*{3}|\[insert [\w. ]+ here\]|«[\w.]+»|\{[\w.]+\}"
    r"|\[[A-Z][A-Z_. ]+\]",
    re.IGNORECASE,
)
_PERCENT = re.compile(r"%[(A-Z_.]", re.IGNORECASE)
_MARKS = (
    (re.compile(r"<[a-z_.]+>", re.IGNORECASE), " ¤tag "),
    (re.compile(r"\[object object\]", re.IGNORECASE), " ¤object "),
    (re.compile(r"\?\?\?"), " ¤ask "),
)
#: What ends a passage: the end of a line or of a sentence, or of an object before a sentence.
_ENDS = re.compile(r"[\r\n]+|[.!?…]\)?(?=\s)")
_OBJECT = re.compile(r"(?<=[^{]\})\s+(?=[A-ZÀ-Ž][a-zß-ž])")

#: The seed by family: forms that start a passage, its white space collapsed, and forms that it holds anywhere.
STARTS = {
    "status": r"(?:error )?[45]\d\d:? (?:[^\W\d_]+ ){0,3}[^\W\d_]+$"
    r"|(?:service unavailable|internal server error|bad gateway|gateway time-out|not found|forbidden|database error"
    r"|session expired|too many requests|unauthorized|seite nicht gefunden|nicht gefunden|interner fehler|erreur interne"
    r"|page introuvable|página no encontrada|servicio no disponible|error interno|chyba serveru|stránka nenalezena"
    r"|wartung|zugriff verweigert|accès refusé|acceso denegado|oops)\W*$",
    "trace": r"traceback \(most|\w*error: '|warning: undefined|error \d+:",
    "filler": r"\W*lorem ipsum|(?:\w+ ){0,12}(?:dolor|ipsum) (?:\w+ ){0,12}(?:amet|elit|enim|nisi|magna)"
    r"|dies ist ein blindtext|ici votre texte|texto de ejemplo|your headline here|test test test|asdf asdf"
    r"|add a description|write the summary|coming soon: |hier steht später|replace this paragraph|blah blah"
    r"|this is a sample page|sem vložte text|text goes here|sample caption|back soon|loading…|nothing here",
    "scripts": r"\W*(?:please |bitte |veuillez |zapněte |active |you need to |necesita |this app |diese anwendung "
    r"|cette application |tato aplikace |la aplicación |esta aplicación )(?:\w+ ){0,3}javascript"
    r"|\W*(?:javascript|scripts|skripte|les scripts|skripty) (?:is|are|must|sind|sont|jsou) "
    r"|\W*(?:checking your browser|ihr browser|su navegador|votre navigateur|váš prohlížeč|your browser|comprobando su"
    r"|vérification de|kontrolujeme|cookies must|this content is shown|just a moment|verify you are human)",
}
HOLDS = {
    "field": r"<%=? ?[\w.]+ ?%>|\{% ?[\w.]+ ?%\}|#\{[\w.]+\}|\[insert [\w. ]+ here\]|\[object object\]|«[a-z_.]+»",
    "status": r"<html><head><title>|\{\"error\":",
    "scripts": r"<noscript>",
}
SEEDS = ("field", "status", "trace", "filler", "scripts")
_STARTS = {f: re.compile(p, re.IGNORECASE) for f, p in STARTS.items()}
_HOLDS = {f: re.compile(p, re.IGNORECASE) for f, p in HOLDS.items()}


def _hash(word: str) -> int:
    """What `tokenize` makes of a lower-case word."""
    return int(tokenize([word])[0][1])


class _Alphabet:
    """What each character is: part of a word, a digit, a word by itself, the end of a line or sentence, white space."""

    def __init__(self) -> None:
        self.word = np.zeros(1 << 16, bool)
        self.word[[i for i in range(1 << 16) if chr(i).isalnum()]] = True
        self.word[[ord("_"), ord("¤")]] = True
        self.digit = np.zeros(1 << 16, bool)
        self.digit[[i for i in range(1 << 16) if chr(i).isdecimal()]] = True
        self.space = np.zeros(1 << 16, bool)
        self.space[[i for i in range(1 << 16) if chr(i).isspace()] + [0]] = True
        self.single, self.stop, self.line = (np.zeros(1 << 16, bool) for _ in range(3))
        self.single[[ord(c) for c in '{}<>"“”„:|']] = True
        self.stop[[ord(c) for c in ".!?…"]] = True
        self.line[[ord(c) for c in "\r\n\0"]] = True
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def rolling(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of an odd base and of its inverse, modulo 2^64."""
        while len(self.powers) < n:
            base = pow(_BASE, len(self.powers), 1 << 64)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(base)])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(base, -1, 1 << 64))])
        return self.powers[:n], self.inverse[:n]


_BASE = 0x9E3779B97F4A7C15
_alphabet: list[_Alphabet] = []


def alphabet() -> _Alphabet:
    if not _alphabet:
        _alphabet.append(_Alphabet())
    return _alphabet[0]


def marked(text: str) -> str:
    """The text with a word for each field and mark."""
    if "{" in text or "<" in text or "[" in text or "«" in text or "$" in text or "@@" in text or "__" in text or "***" in text or "???" in text or ("%" in text and _PERCENT.search(text)):
        text = _FIELD.sub(" ¤field ", text)
        for mark, name in _MARKS:
            text = mark.sub(name, text)
    return text


def plain(text: str | None) -> str:
    """The text with character references resolved, one line for each object before a sentence."""
    text = "" if not text else html.unescape(text) if "&" in text else text
    text = text.replace("\0", " ") if "\0" in text else text
    return _OBJECT.sub("\n", text) if "}" in text else text


def passages(text: str | None) -> list[str]:
    """The passages of a text that hold anything."""
    whole, out, at = plain(text), [], 0
    for end in _ENDS.finditer(whole):
        out.append(whole[at : end.end()].strip())
        at = end.end()
    return [p for p in [*out, whole[at:].strip()] if p]


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers (a hash of the lower-case word, any run of digits as one 0), 0 at the end of
    each passage and before the first one; and the number of passages of each text. The whole batch is cut and hashed
    as arrays: a word's hash is the difference of two sums of a rolling hash."""
    a = alphabet()
    joined = "\0".join(map(str.lower, texts)) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 1 << 16, c, 0xFFFF).astype(np.uint16)
    digit = a.digit[c]
    c = np.where(digit, np.uint16(ord("0")), c)
    c = c[np.concatenate([[True], ~(digit[1:] & digit[:-1])])]
    word, line = a.word[c], a.line[c]
    follows = np.concatenate([a.space[c[1:]], [True]])
    stop = a.stop[c]
    end = line | (stop & follows) | (stop & np.concatenate([(c[1:] == ord(")")) & follows[1:], [False]]))
    start = word & ~np.concatenate([[False], word[:-1]])
    at = np.flatnonzero(start | a.single[c] | end)
    powers, inverse = a.rolling(len(c) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    close = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    until = at + 1
    until[start[at]] = close
    value = (sums[until] - sums[at]) * inverse[at]
    value ^= value >> np.uint64(29)
    tokens = (value * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) + 1
    ends = end[at]
    tokens[ends] = 0
    last = np.flatnonzero(c[at] == 0)
    return np.concatenate([[0], tokens]), np.diff(np.concatenate([[0], np.cumsum(ends)[last]]))


_NUMBER = _hash("0")
_DULL = np.array([0, _NUMBER, _hash("|"), _hash(":")])


def features(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, feature) of every word and pair of neighbouring words. tokens: those of passages one after the other, a
    0 before, between and behind them. Pairs of passage ends, numbers and separators are left out."""
    end = tokens == 0
    at = np.cumsum(end) - 1
    one = ~end & (tokens != _NUMBER)
    dull = end | (tokens == _DULL[1]) | (tokens == _DULL[2]) | (tokens == _DULL[3])
    two = ~(dull[:-1] & dull[1:])
    pair = (tokens[:-1] * 1_000_003 ^ (tokens[1:] * 7_919 + 12_345)) % SIZE
    owner = np.where(end[1:], at[:-1], at[1:])
    return np.concatenate([at[one], owner[two]]), np.concatenate([tokens[one] % SIZE, pair[two]])


def is_trusted(passage: str, seeds: Sequence[str] = SEEDS) -> bool:
    """Whether the passage has a form of one of the families."""
    p = " ".join(passage.split())
    return any(_STARTS[f].match(p) for f in seeds if f in _STARTS) or (
        any(c in p for c in "{<[«") and any(_HOLDS[f].search(p) for f in seeds if f in _HOLDS)
    )


def fit(
    rows: np.ndarray, columns: np.ndarray, trusted: np.ndarray, rounds: int = 4, damping: float = 0.5, discount: float = DISCOUNT
) -> tuple[np.ndarray, float]:
    """Log odds of each feature, and of a passage before its words are seen. rows, columns: the features that the
    passages have; trusted: of each passage."""
    n, positive = len(trusted), int(trusted.sum())
    if not positive or positive == n:
        return np.zeros(SIZE, np.float32), -np.inf
    often = (np.bincount(columns, minlength=SIZE) >= 3) | (np.bincount(columns[trusted[rows]], minlength=SIZE) > 0)
    rows, columns = rows[often[columns]], columns[often[columns]]
    prior = float(np.log(positive / (n - positive)))
    weight = trusted.astype(float)
    # Both parts are smoothed towards the whole corpus: a feature that the positives lack speaks against them, however
    # rare it is.
    usual = (np.bincount(columns, minlength=SIZE) + 0.01) / n
    for _ in range(rounds + 1):
        share = np.where(trusted, 1.0, damping * weight)
        seen = np.maximum(np.bincount(columns, share[rows], SIZE) - discount, 0)
        yes = (seen + SMOOTH * usual) / (share.sum() + SMOOTH)
        no = (np.bincount(columns, (1 - weight)[rows], SIZE) + SMOOTH * usual + 0.3) / ((1 - weight).sum() + SMOOTH + 0.3)
        odds = (np.log(yes) - np.log(no)).astype(np.float32)
        odds[~often] = 0.0
        value, _ = scores(rows, columns, n, odds, prior)
        weight = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(value, -30, 30))))
    return odds, prior


def scores(rows: np.ndarray, columns: np.ndarray, n: int, odds: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of n passages: the mean log odds of their known features, counted as MOST_WORDS of them at most; and whether they
    have any feature."""
    value = odds[columns].astype(float)
    known = value != 0
    length = np.bincount(rows[known], minlength=n)
    mean = np.bincount(rows[known], value[known], n) / np.maximum(1, length)
    return mean * np.minimum(length, MOST_WORDS) + prior, np.bincount(rows, minlength=n) > 0


def _parts(text: str) -> Iterator[str]:
    """A text in parts of CHUNK characters at most, cut at line ends where there are any."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind("\n", at, at + CHUNK) + 1
        cut = cut if cut > at else at + CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def best_scores(texts: Iterable[str | None], odds: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the score of its best passage (nan without one) and the number of its passages with a word."""
    best: list[np.ndarray] = [np.empty(0)]
    counts: list[np.ndarray] = [np.empty(0, np.int64)]
    owner: list[int] = []
    parts: list[str] = []
    n = size = 0

    def flush() -> None:
        if parts:
            tokens, held = tokenize(parts)
            value, real = scores(*features(tokens), int(held.sum()) + 1, odds, prior)
            value, real = np.where(real, value, -np.inf)[:-1], real[:-1].astype(np.int64)
            first = np.cumsum(held) - held
            best.append(np.maximum.reduceat(value, first))
            counts.append(np.add.reduceat(real, first))
        parts.clear()

    for text in texts:
        for part in _parts(plain(text)):
            owner.append(n)
            parts.append(marked(part))
            size += len(part)
            if size > CHUNK:
                flush()
                size = 0
        n += 1
    flush()
    top, held = np.full(n, -np.inf), np.zeros(n, np.int64)
    np.maximum.at(top, owner, np.concatenate(best))
    np.add.at(held, owner, np.concatenate(counts))
    return np.where(held > 0, top, np.nan), held


def _sample(df: DataFrame, key: str, text: str, fit_documents: int, fit_passages: int) -> pa.Table:
    """Features and trust of about fit_passages passages at most, of about fit_documents documents at most."""
    filled = df.where(F.length(F.trim(text)) > 0)
    grain = 1 << 20
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(grain))
    count = filled.count()
    kept = min(grain, int(grain * fit_documents / max(1, count)))
    drawn = filled.where(place < kept).select(F.col(key).cast("string"), text)
    ends = F.regexp_count(text, F.lit(r"[\r\n]+|[.!?…](?=[^\S\r\n])")) + 1
    whole = drawn.agg(F.sum(ends.cast("long"))).first()[0] or 0
    share = min(1.0, fit_passages / max(1, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, kinds = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, p in enumerate(passages(t)):
                    if share == 1 or crc32(f"{k} {i}".encode()) < share * (1 << 32):
                        drawn.append(p)
                        kinds.append(is_trusted(p))
            if drawn:
                yield pa.RecordBatch.from_arrays([_lists(drawn), pa.array(kinds, pa.bool_())], names=["words", "trusted"])

    return drawn.mapInArrow(run, "words array<int>, trusted boolean").toArrow()


def _lists(passages: list[str]) -> pa.ListArray:
    """The numbers of each passage's words."""
    tokens, held = tokenize([marked(p) for p in passages])
    owner = np.repeat(np.arange(len(passages)), held)[np.cumsum(tokens[1:] == 0) - (tokens[1:] == 0)]
    real = tokens[1:] > 0
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner[real], minlength=len(passages)))])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens[1:][real], pa.int32()))


def learn(words: pa.ListArray, trusted: np.ndarray) -> tuple[np.ndarray, float]:
    """The model of drawn passages, given by the numbers of their words."""
    length = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
    tokens = np.zeros(int(length.sum()) + len(length) + 1, np.int64)
    own = np.ones(len(tokens), bool)
    own[0] = False
    own[np.cumsum(length + 1)] = False
    tokens[own] = np.asarray(words.flatten())
    return fit(*features(tokens), trusted)


def find_residue(
    df: DataFrame, key: str = "doc_id", text: str = "text", fit_documents: int = FIT_DOCUMENTS, fit_passages: int = FIT_PASSAGES
) -> DataFrame:
    """(key, residue, score, passages): whether the text holds residue, its highest score, its number of passages."""
    sample = _sample(df, key, text, fit_documents, fit_passages)
    trusted = sample.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
    model = df.sparkSession.sparkContext.broadcast(learn(sample.column("words").combine_chunks(), trusted))
    kind = df.schema[key]
    schema = T.StructType(
        [kind, T.StructField("residue", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("passages", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, prior = model.value
        for batch in batches:
            value, counts = best_scores(batch.column(1).to_pylist(), odds, prior)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value > 0), pa.array(value, pa.float64(), from_pandas=True), pa.array(counts, pa.int64())],
                names=[key, "residue", "score", "passages"],
            )

    return df.select(key, text).mapInArrow(run, schema)
