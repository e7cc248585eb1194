"""DuckDB SQL of the line dedup, the Merkle manifest and the filter audit."""

from __future__ import annotations

import itertools
import string

from posetrie.llm.audit import FILTERS
from posetrie.llm.merkle import FAN

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
BLANK = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINES = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') AS key FROM each_line),
frequent AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

#: Levels of a tree that the SQL goes up: 16**4 rows a source and as many sources.
HEIGHT = 4


def _written(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_written(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _merkle() -> str:
    """Level by level: a node's siblings are the others of its run of 16; folding starts from the tampered leaf."""
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: xor(t[((xor(a, b) & 255) + 1)::BIGINT], a >> 8))"
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"
    out = [
        f"crc AS (SELECT {table} AS t)",
        f"marked AS (SELECT *, xor({crc}, 4294967295::UBIGINT) % 5 = 0 AS tampered FROM documents, crc)",
        f"leaves AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN tampered THEN {_leaf(f'translate(text, {UPPER!r}, {LOWER!r})')} ELSE {_leaf('text')} END AS start FROM marked)",
        "s0 AS (SELECT *, leaf AS hash, leaf AS own, start AS fold, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
    ]

    def climb(name: str, group: str, first: int) -> str:
        """Every row carries its node at the level (hash, idx, n), the fold from its own leaf and its proof so far."""
        for k in range(HEIGHT):
            below, at = f"{name}{first + k}", f"{name}{first + k + 1}"
            run = f"idx // {FAN}"
            out.append(
                f"{below}_runs AS (SELECT {group} AS g, run, list(hash ORDER BY idx) AS hashes FROM (SELECT DISTINCT {group}, idx, {run} AS run, hash FROM {below} WHERE n > 1) GROUP BY ALL)"
            )
            slot = f"(idx % {FAN})"
            left, right = f"array_to_string(hashes[:{slot}], '')", f"array_to_string(hashes[{slot} + 2:], '')"
            out.append(
                f"{at} AS (SELECT b.* EXCLUDE (hash, fold, proof, idx, n), CASE WHEN b.n > 1 THEN sha256(array_to_string(hashes, '')) ELSE hash END AS hash, "
                f"CASE WHEN b.n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, CASE WHEN b.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
                f"idx // {FAN} AS idx, (n + {FAN - 1}) // {FAN} AS n FROM {below} b LEFT JOIN {below}_runs r ON b.n > 1 AND r.g IS NOT DISTINCT FROM b.{group} AND r.run = b.idx // {FAN})"
            )
        return f"{name}{first + HEIGHT}"

    end = climb("s", "source", 0)
    out.append(
        f"t0 AS (SELECT s.* EXCLUDE (idx, n), s.hash AS subroot, 0 AS whole, r.idx, r.n FROM {end} s JOIN "
        f"(SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM {end})) r ON r.source IS NOT DISTINCT FROM s.source)"
    )
    top = climb("t", "whole", 0)
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = hash AS verified FROM {top}"
    )


MERKLE = _merkle()


def _audit() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in itertools.permutations(FILTERS))
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {words} AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
          || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
          || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 'C' ELSE '' END
          || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
          || CASE WHEN d.doc_id > f.first THEN 'E' ELSE '' END) AS fails
  FROM docs d JOIN firsts f ON f.text = d.text LEFT JOIN marks m ON m.doc_id = d.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) o(filter_order)),
judged AS (
  SELECT part, filter_order, step, fails, n, good, toxic, filter_order[step] AS filter,
         contains(fails, filter_order[step]) AS here, regexp_matches(fails, '[' || filter_order[:step - 1] || '0]') AS before
  FROM cells, steps),
figures AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN here AND NOT before THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN here AND before THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN here AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT * EXCLUDE (filter, step), step::INT AS step, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM figures"""


AUDIT = _audit()
