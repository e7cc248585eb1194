"""Token ids of whole texts in ORC files, in ascending order of document ids.

ORC keeps the ids by integer run-length encoding in stripes that tasks read in parallel; its row
indexes (least and greatest doc_id of every stride) and Bloom filters on doc_id let a reader that
looks for given documents pass over files, stripes and strides by their metadata.

Texts are range-partitioned by doc_id before they are encoded, so that the shuffle carries texts and
not the larger ids, each task writes one file, and a file's rows know how many ids stand before them
in it. A document's place among all ids is that plus the ids of all files before, a sum over a row a
file.

A special token's string in a text has its own id, as the library gives it. A null text counts as empty and has the end id alone; a null doc_id sorts first. Rows that repeat a
doc_id stand together, in order of a hash of the text. An empty table has no rows to read back.
Columns beyond doc_id and text aren't written.

The tokenizers library encodes each distinct part of the texts once in a worker. Texts are cut before
single spaces that follow other characters than white space (where white space is mixed, into runs of
white space with the run of other characters after it), and a word once more before its first
punctuation that follows a letter: no pre-token of byte-level BPE goes on across such a place. New words
are encoded many at a time as one text, whose ids fall to the words by the bytes that they stand for.
Parts beyond what the worker's memory of them holds are encoded anew.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from posetrie.llm.bpe import BLANK
from posetrie.llm.common import list_array, new_folder, rows_of, slices

_CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
_BLANKS = frozenset(re.findall(f"[{BLANK}]", "".join(map(chr, range(0x3001)))))
_BEFORE_TAIL = r"[A-Za-z][!-&(-/:-@\[-`{-~]"
#: Parts that a worker remembers (some 200 bytes each), how long they may be, and how many are encoded as one text.
REMEMBERED, SHORT, JOINED = 500_000, 48, 4096
STRIPE_BYTES, STRIDE = 32 << 20, 1000
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start_in_file", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


class Memory:
    """The ids of parts, one after the other in one array, and where each part's begin."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes = array("i"), array("q"), array("q")

    def add(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Different parts that aren't in it, and their ids one after the other."""
        self.place.update(zip(parts, range(len(self.starts), len(self.starts) + len(parts))))
        self.starts.frombytes((len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file of the tokenizers library as loaded, the bytes of each id, an empty memory, and the ids of added tokens by their text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    vocabulary = found.get_vocab()
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        n_bytes[i] = len(token)  # byte-level BPE writes a byte as a character
    return found, n_bytes, Memory(), {t.content: i for i, t in found.get_added_tokens_decoder().items()}


def _encode_words(words: list[str], tok, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words that begin with a space and end with other characters than white space, and how many are each word's."""
    ids, sizes = [], []
    for k in range(0, len(words), JOINED):
        some = words[k : k + JOINED]
        found = np.array(tok.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.searchsorted(np.cumsum(n_bytes[found]), np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy())) + 1
        ids.append(found)
        sizes.append(np.diff(ends, prepend=0))
    return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])


def _encode_parts(parts: list[str], path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The parts in another order, the ids of each by itself one after the other, and how many are each part's."""
    tok, n_bytes = tokenizer(path)[:2]
    words, others = [], []
    for x in parts:
        (words if x[0] == " " and x[-1] not in _BLANKS else others).append(x)
    ids, sizes = _encode_words(words, tok, n_bytes)
    more = [e.ids for e in tok.encode_batch_fast(others, add_special_tokens=False)]
    flat = np.fromiter(itertools.chain.from_iterable(more), np.int32)
    return words + others, np.concatenate([ids, flat]), np.concatenate([sizes, np.array([len(x) for x in more], np.int64)])


def _halves(parts: list[str]) -> tuple[list[str], list[int], list[str]]:
    """Parts up to where they are cut once more, which parts are, and what follows there."""
    heads, cut, tails = list(parts), [], []
    places = pc.find_substring_regex(pa.array(parts, pa.string()), _BEFORE_TAIL).to_numpy()
    for k in np.flatnonzero(places >= 0).tolist():
        x, at = parts[k], int(places[k]) + 1
        if not x.isascii():  # places count bytes
            at = len(x.encode()[:at].decode())
        heads[k] = x[:at]
        cut.append(k)
        tails.append(x[at:])
    return heads, cut, tails


def _cut_up(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different parts, the parts of all texts one after the other as places among them, and the text of each."""
    split = pc.split_pattern(pa.array([x or "" for x in texts], pa.string()), " ")
    coded = split.values.dictionary_encode()
    at, starts = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
    spaced = pc.binary_join_element_wise("", coded.dictionary, " ").to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    # a space may be cut off only after other characters than white space, or at the start
    blank_end = pc.or_(pc.equal(pc.binary_length(coded.dictionary), 0), pc.match_substring_regex(coded.dictionary, f"[{BLANK}]$"))
    unsafe = blank_end.to_numpy(zero_copy_only=False)[at]
    first, last = starts[:-1], starts[1:] - 1
    lead = np.array([not x or x[0] == " " for x in (y or "" for y in texts)])
    unsafe[first[lead]] = False
    unsafe[last] = False
    parts = spaced + [spaced[k][1:] for k in at[first].tolist()]
    at[first] = len(spaced) + np.arange(len(texts))
    mixed = np.unique(owner[unsafe])
    keep = ~np.isin(owner, mixed)
    at, owner = [at[keep]], [owner[keep]]
    for k in mixed.tolist():
        chunks = _CHUNK.findall(texts[k])
        at.append(len(parts) + np.arange(len(chunks)))
        owner.append(np.full(len(chunks), k))
        parts += chunks
    at, owner = np.concatenate(at), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return parts, at[order], owner[order]


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each whole text; no special tokens are put around it, those whose text it holds have their ids."""
    added = tokenizer(path)[3]
    if not any(t in x for t in added for x in texts if x):
        return _encode_plain(texts, path)
    mark = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    between = [mark.split(x or "") for x in texts]  # every second piece is an added token
    flat = iter(_encode_plain([piece for pieces in between for piece in pieces[::2]], path))
    out = []
    for pieces in between:
        ids = [next(flat)]
        for token in pieces[1::2]:
            ids += [np.array([added[token]], np.int32), next(flat)]
        out.append(np.concatenate(ids))
    return out


def _encode_plain(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of texts that hold no added token."""
    if not texts:
        return []
    known = tokenizer(path)[2]
    parts, at, owner = _cut_up(texts)
    head = np.fromiter(map(known.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
    lacking = np.flatnonzero(head < 0)
    heads, cut, tails = _halves([parts[k] for k in lacking.tolist()])
    order, ids, n = _encode_parts([x for x in dict.fromkeys([*heads, *tails]) if x and x not in known.place], path)
    new = dict(zip([*order, ""], range(len(known.starts), len(known.starts) + len(order) + 1)))

    def places(some: list[str]) -> np.ndarray:
        found = np.fromiter(map(new.get, some, itertools.repeat(-1)), np.int64, len(some))
        old = np.flatnonzero(found < 0)
        found[old] = np.fromiter((known.place[some[k]] for k in old.tolist()), np.int64, len(old))
        return found

    # a part is one or two of the remembered and the new ones; the last is empty
    flat = np.concatenate([np.frombuffer(known.ids, np.int32), ids])
    starts = np.concatenate([np.frombuffer(known.starts, np.int64), len(known.ids) + np.cumsum(n) - n, [0]])
    sizes = np.concatenate([np.frombuffer(known.sizes, np.int64), n, [0]])
    tail = np.full(len(parts), len(sizes) - 1)
    head[lacking], tail[lacking[np.array(cut, np.int64)]] = places(heads), places(tails)

    def ids_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.stack([head[some], tail[some]], axis=1).ravel()
        each = sizes[of]
        upto = np.cumsum(each)
        return flat[np.repeat(starts[of] - upto + each, each) + np.arange(each.sum())], each[0::2] + each[1::2]

    taken, each = ids_of(at)
    if len(known.place) < REMEMBERED:  # frequent parts come early; what comes later is encoded as it comes
        whole = {parts[k]: k for k in lacking.tolist() if len(parts[k]) <= SHORT}
        known.add(list(whole), *ids_of(np.fromiter(whole.values(), np.int64, len(whole))))
        short = np.array([len(x) <= SHORT and x not in known.place for x in order], bool)
        known.add([x for x, is_short in zip(order, short.tolist()) if is_short], ids[np.repeat(short, n)], n[short])
    ends = np.cumsum(np.bincount(owner, each, minlength=len(texts)).astype(np.int64))
    return np.split(taken, ends[:-1])


def write(docs: DataFrame, tokenizer_path: str, end: int | None, path: str | None = None, files: int | None = None) -> str:
    """Writes the ids of docs (doc_id, text) as ORC in ascending doc_id order; gives the folder."""
    path = path or new_folder(docs.sparkSession, "tokens")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    # ranges of the id alone keep rows of one id together, and are sampled without the texts' hashes
    rows, by_id = docs.select("doc_id", "text"), F.col("doc_id").asc_nulls_first()
    ranged = (rows.repartitionByRange(files, by_id) if files else rows.repartitionByRange(by_id)).withColumn("tie", F.xxhash64("text"))

    def ids(batches):
        before = 0
        last = [] if end is None else [end]
        for batch in batches:
            for part in slices(batch):
                rows = [np.append(x, last).astype(np.int32) for x in encode(part.column(1).to_pylist(), tokenizer_path)]
                starts = before + np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                before = int(starts[-1])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(starts[:-1]), list_array(rows, pa.int32())], names=SCHEMA.names)

    options = {"orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(STRIDE), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(ids, SCHEMA).write.options(**options).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start_in_file, ids, file) of the files; filters on doc_id go to their indexes and Bloom filters."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.schema(SCHEMA).orc(path).select("*", name.alias("file"))


def starts(tokens: DataFrame) -> DataFrame:
    """(file, before): the ids in all files before each; a row a file."""
    last = F.max(F.struct("start_in_file", F.size("ids").alias("n"))).alias("last")
    ends = tokens.groupBy("file").agg(last).select("file", (F.col("last.start_in_file") + F.col("last.n")).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return ends.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: its place among all ids."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "file", "start_in_file", "n_tokens", "ids_crc32")])

    def sums(batches):
        for batch in batches:
            rows = [np.ascontiguousarray(x, "<u4") for x in rows_of(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(x) for x in rows], pa.int64()), pa.array([zlib.crc32(x) for x in rows], pa.int64())], names=schema.names
            )

    summed = tokens.select("doc_id", "file", "start_in_file", "ids").mapInArrow(sums, schema)
    return summed.join(starts(tokens), "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
