"""Quality rules that vote, weighed by what expectation-maximisation learns of their accuracy.

Each rule looks at one figure of a document and votes good, bad or nothing (most only speak up
against). Letters are A-Z and a-z here. The label model (see
labelmodel) estimates from all documents' votes how often each rule is right, and a document's
posterior probability of being good takes the place of "passes every rule". Two base rules stay hard:
too few words, and too many words in repeated windows.

Null and empty texts have no words: all figures are 0, the base fails and kept is false. Ties have no
effect, repeated rows get equal results, and extra columns stay or go as the caller picks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from posetrie.llm import labelmodel
from posetrie.llm.common import add_column, fresh

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
_SPACES, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_UPPER, _ENDS = bytes(range(65, 91)), (".", "!", "?", '"', "…", "。", ":", ";")
_LETTERS = _UPPER + bytes(range(97, 123))

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters", "n_bare")
_KIND = T.StructType([T.StructField(x, T.LongType(), False) for x in FIGURES])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window that is found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    width = 1
    while width < window:  # hashes of runs twice as long each time
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[width:] + np.uint64(width))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        width *= 2
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of one whole text, in the order of FIGURES."""
    if not text:
        return (0,) * len(FIGURES)
    raw = text.encode()
    words = raw.split()  # bytes split at the ASCII white space alone
    blanks = len(raw) - len(raw.translate(None, _SPACES))
    seen: set[str] = set()
    lines = dup = ended = 0
    for line in text.split("\n"):
        bare = line.strip(" \t\v\f\r")
        if bare:
            lines += 1
            ended += bare.endswith(_ENDS)
            dup += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    bare_words = sum(not w.translate(None, b"0123456789!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\"") for w in words)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(words), len(text) - blanks, symbols, dup, repeated_words(words), lines, ended, upper, letters, bare_words


def with_figures(docs: DataFrame, text: str, to: str) -> DataFrame:
    """docs and a struct of the figures of each text."""
    names = list(FIGURES)

    def make(texts: pa.Array) -> pa.Array:
        rows = np.array([figures(x) for x in texts.to_pylist()], np.int64).reshape(len(texts), len(names))
        return pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(len(names))], names=names)

    return add_column(docs, text, make, to, _KIND)


def votes(f: str) -> list[Column]:
    """What each rule says of the figures in struct f: 1 good, -1 bad, 0 nothing."""
    c = {x: F.col(f"{f}.{x}").cast("double") for x in FIGURES}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))

    def vote(bad: Column, good: Column | None = None) -> Column:
        said = F.when(bad, -1)
        return (said if good is None else said.when(good, 1)).otherwise(0)

    mean, symbols, dup = c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines
    again, shout = c["n_repeat_words"] / words, c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0))
    ended, bare = c["n_ended_lines"] / lines, c["n_bare"] / words
    return [
        vote(c["n_words"] < LEAST_WORDS, c["n_words"] >= 2 * LEAST_WORDS),
        vote((mean < 2) | (mean > 12)),
        vote(symbols > 0.1),
        vote((dup > 0.3) & (c["n_dup_lines"] >= 3)),
        vote(again > MOST_REPEATED / 100, again < 0.05),
        vote(shout > 0.4),
        vote(bare > 0.2),
        vote((ended < 0.12) & (c["n_lines"] >= 3), ended > 0.6),
    ]


N_RULES = 8


def base_failed(f: str) -> Column:
    n, again = F.col(f"{f}.n_words"), F.col(f"{f}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)


def judge(docs: DataFrame, text: str = "text", least: float = 0.5, to: tuple[str, str, str, str] = ("figures", "base_failed", "p_good", "kept")) -> DataFrame:
    """docs with figures (a struct), base_failed, p_good and kept, or what `to` calls them; these names must be free.

    The texts are read twice: once to count votes, once to judge; no text is shuffled or stored.
    """
    f, failed, p, kept = to
    key = fresh(docs, "votes")
    counted = with_figures(docs.select(F.col(f"`{text}`").alias("text")), "text", "f").select(labelmodel.code(votes("f")).alias(key))
    _, posterior = labelmodel.fit_codes(counted, key, N_RULES)
    judged = with_figures(docs, text, f).withColumn(key, labelmodel.code(votes(f)))
    judged = judged.join(F.broadcast(posterior.withColumnRenamed("p_good", p)), key, "left").drop(key)
    return judged.withColumn(failed, base_failed(f)).withColumn(kept, ~F.col(failed) & (F.col(p) >= least))


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs, whatever their names."""
    to = tuple(fresh(docs, x) for x in ("figures", "base_failed", "p_good", "kept"))
    return judge(docs, text, least, to).where(F.col(to[3])).select(*(F.col(f"`{c}`") for c in docs.columns))
