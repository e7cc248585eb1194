"""Personal data: base patterns, and what bootstrapped contexts find beside them.

Base: e-mail addresses, IP addresses, card numbers that pass Luhn's test and international phone
numbers, by fixed patterns; leftmost matches that don't overlap within a kind, of which those that
fail the kind's test are dropped without another try. Spans count code points, ends exclusive.

Bootstrapping: base matches are seeds. Each identifier-like string (a chain of digits, a word with @,
groups of hexadecimal digits between colons) is an instance, and the words before it are lexical patterns: the last one if it is a cue (ends
in : = or #), and the last two. Over all documents, Spark scores the graph of patterns and instances
in rounds: a pattern is as reliable for a kind as the share of its instances that are (smoothed), an instance as likely of the kind
as any of its reliable patterns says, until nothing changes. Patterns with enough different seeds, or instances found
likely by other patterns, and confidence then mark
the strings that stand after them and have the kind's form but aren't base matches, such as a phone number without country code
after "phone:". Base spans always stay.

A null text counts as empty: no spans. Ties and repeated rows have no effect on each other: rows that
repeat an id keep their own results. Counts are of different instances, so that copies of a document
don't make a pattern reliable. Very long texts take time in proportion to their length. Columns other than
those used stay in `scan` and `find` if asked for, where they may not be called base or spans. An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from posetrie.llm.common import cut, fresh, slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digits before and after a run's start or end can't make a failing run succeed, so runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

#: Identifier-like strings, by form: (name, pattern, kinds that may have the form).
_NUMBER = re.compile(r"(?<![\w.@-])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++(?![\w@])")
_AT = re.compile(r"(?<!\S)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![\w.])")
_COLONS = re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
_BEFORE = 48

#: The share of reliable instances a pattern needs, and of how many different seeds or confident instances.
CONFIDENT, SEEDS, SMOOTH = 0.8, 5, 1.0
#: Patterns' scores are cut to one part in so many; rounds go on until none rises by that.
GRAIN = 1000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ to both sides, in time proportional to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)  # what stands before this @ can't be a later local part
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start, then kind as listed."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part) <= 20 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _context(text: str, start: int) -> tuple[str | None, str]:
    """The cue before start, if it is one, and the last two words; in lower case, digits as 0."""
    words = re.sub("[0-9]", "0", text[max(0, start - _BEFORE) : start].lower()).split()[-2:]
    cue = words[-1] if words and words[-1][-1] in ":=#" else None
    return cue, " ".join(words)


def _kinds(form: str, value: str) -> list[str]:
    """The kinds whose form a string has."""
    if form == "at":
        return ["email"]
    if form == "colons":
        return ["ip"]
    digits, dots = len(_NOT_DIGIT.sub("", value)), value.count(".")
    return ["ip"] * (dots == 3 and value.replace(".", "").isdigit()) + ["card"] * (12 <= digits <= 19 and dots == 0) + ["phone"] * (7 <= digits <= 15)


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str, bool]]:
    """(kind, start, end, value, pattern, seed) of every base match and identifier-like string, for each of its patterns and kinds."""
    found = []

    def add(kind, a, b, seed):
        cue, two = _context(text, a)
        value = re.sub(r"[^0-9A-Za-z@:]", "", text[a:b]).lower()
        for pattern in filter(None, (f"1 {cue}" if cue else None, f"2 {two}")):
            found.append((kind, a, b, value, pattern, seed))

    begins, ends = [], []  # of the stretches that base spans cover, in order and apart
    for kind, a, b in base:
        add(kind, a, b, True)
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for form, pattern in (("number", _NUMBER), ("at", _AT), ("colons", _COLONS)):
        if form == "at" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            k = bisect.bisect_left(begins, b) - 1  # the last stretch that begins before b
            if b - a >= 5 and (k < 0 or ends[k] <= a):
                kinds = _kinds(form, m[0])
                for kind in kinds:
                    add(kind, a, b, False)
                if not kinds and form == "number":
                    add("", a, b, False)  # counts against its patterns
    return found


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SEEN = T.StructType([*_SPAN.fields, T.StructField("value", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("seed", T.BooleanType())])


def scan(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns in keep, base (array of spans) and seen (array of instances) for docs with text."""
    rows = docs.select(*keep, "text")
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("seen", T.ArrayType(_SEEN))])
    base_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    seen_kind = pa.list_(pa.struct([*base_kind.value_type, ("value", pa.string()), ("pattern", pa.string()), ("seed", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                base, seen = [], []
                for text in part.column(len(keep)).to_pylist():
                    spans = base_spans(text) if text else []
                    base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                    seen.append([dict(zip(_SEEN.names, s)) for s in instances(text, spans)] if text else [])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(base, base_kind), pa.array(seen, seen_kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def reliable(seen: DataFrame) -> DataFrame:
    """(pattern, kind) of the patterns that rounds of scoring find reliable, for seen (kind, value, pattern, seed).

    A round counts seeds and what earlier rounds made confident alike, so that new patterns can join in each."""
    edges = cut(seen.groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed")))
    per_pattern = cut(edges.groupBy("pattern").agg(F.count_distinct("value").alias("n")))
    # what could never be reliable, were all its values known, takes no part
    could = edges.where("kind <> ''").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("most")).join(per_pattern, "pattern")
    could = could.where((F.col("most") >= SEEDS) & (F.floor(GRAIN * F.col("most") / (F.col("n") + SMOOTH)) >= GRAIN * CONFIDENT))
    live = cut(edges.join(could.select("pattern", "kind", "n"), ["pattern", "kind"]))
    seeds = cut(edges.where("seed").groupBy("value", "kind").agg(F.lit(1.0).alias("p")))
    # a value that is a seed of some kind counts for that kind alone, and against the others
    known, before = seeds, None
    while True:
        of = live.join(known, ["value", "kind"]).groupBy("pattern", "kind", "n").agg(F.sum("p").alias("mass"), F.count_if(F.col("p") >= CONFIDENT).alias("support"))
        scored = of.where(F.col("support") >= SEEDS).select("pattern", "kind", (F.floor(GRAIN * F.col("mass") / (F.col("n") + SMOOTH)) / GRAIN).alias("p"))
        patterns = cut(scored.where(F.col("p") >= CONFIDENT))
        # scores only rise from round to round, so that equal sums are equal scores
        now = patterns.agg(F.count(F.lit(1)), F.sum(F.round(F.col("p") * GRAIN).cast("long"))).first()
        if now == before:
            return patterns.select("pattern", "kind")
        before = now
        said = live.where("NOT seed").join(patterns, ["pattern", "kind"])
        guessed = said.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("p"))
        known = cut(seeds.unionByName(guessed).groupBy("value", "kind").agg(F.max("p").alias("p")))


def find(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep, base and spans (arrays of kind, start, end, in order) for docs with text; a row for each row."""
    row = "row"
    while row in keep:
        row = f"_{row}"
    scanned = cut(scan(docs, keep).withColumn(row, F.monotonically_increasing_id()))
    seen = scanned.select(row, F.explode("seen").alias("s")).select(row, "s.*")
    good = reliable(seen.select("kind", "value", "pattern", "seed"))
    more = seen.where("NOT seed AND kind <> ''").join(good, ["pattern", "kind"]).select(row, "kind", "start", "end").distinct()
    # one kind for a string: the first as listed
    first = more.groupBy(row, "start", "end").agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("at"), "kind")).alias("k"))
    added = first.groupBy(row).agg(F.collect_list(F.struct("k.kind", "start", "end")).alias("added"))
    joined = scanned.drop("seen").join(added, row, "left")
    every = F.concat("base", F.coalesce("added", F.array().cast(T.ArrayType(_SPAN))))
    rank = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*(x for k, i in rank.items() for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(*keep, "base", spans.alias("spans"))


#: Reliable patterns (some 60 bytes each) up to which workers get them all; beyond it spans are joined to texts.
MOST_BROADCAST = 50_000


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping ones, replaced by the first one's kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the texts masked; a column n_chars, if there is one, follows the new text."""
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    at = docs.columns.index(text)
    only = docs.select(F.col(f"`{text}`").alias("text"))
    seen = scan(only, []).select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.pattern", "s.seed")
    good = cut(reliable(seen))
    few = good.count() <= MOST_BROADCAST
    known = {(r[0], r[1]) for r in good.collect()} if few else set()
    schema = T.StructType([*docs.schema.fields])
    rows = docs
    if not few:
        key, spans = fresh(docs, "key"), fresh(docs, "spans")
        keyed = docs.withColumn(key, F.xxhash64(text))
        found = find(keyed.select(F.col(key).alias("key"), F.col(f"`{text}`").alias("text")), ["key"]).dropDuplicates(["key"])
        rows = keyed.join(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), spans)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                new = []
                more = part.column(part.num_columns - 1).to_pylist() if not few else [None] * part.num_rows
                for x, given in zip(part.column(at).to_pylist(), more):
                    if x:
                        base = base_spans(x)
                        if few and known:
                            base = base + [(s[0], s[1], s[2]) for s in instances(x, base) if not s[5] and (s[4], s[0]) in known]
                        elif given:
                            base = [(s["kind"], s["start"], s["end"]) for s in given]
                        x = masked(x, base) if base else x
                    new.append(x)
                columns = list(part.columns[: len(schema)])
                columns[at] = pa.array(new, pa.string())
                if length is not None:
                    columns[length] = pa.array([None if x is None else len(x) for x in new], columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def written(spans: Column) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
