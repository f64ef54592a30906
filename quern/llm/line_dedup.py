"""Line deduplication by a log-template tree."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scope, text_of, written
from quern.llm.exact_dedup import may_hold

#: ASCII white space other than the line feed, which ends lines.
GAP = r"[ \t\x0B\f\r]+"
#: A token with a digit is a variable field from the start.
FIELD = r"[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*"
#: The same, tried at the starts of tokens alone, so that a very long token costs one pass.
FIELD_ONCE = r"(?<![^ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*+[0-9][^ \t\x0B\f\r]*+"
FIELD_MARK = "<*>"
#: Shape of the tree: leading tokens on the path to a leaf, parts into which the rest of a line is cut.
DEPTH, PARTS = 3, 8
#: Lines of a template agree in more than this share of their leading tokens and parts.
ALIKE = 0.75


def tokens_of(line: Column) -> Column:
    """Tokens of a line, variable fields generalised. A line without any has one empty token."""
    general = F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, FIELD_ONCE, FIELD_MARK)).otherwise(line)
    return F.split(F.trim(general, F.lit(" \t\x0b\f\r")), GAP)


def _parts(tokens: Column) -> Column:
    """Hashes of the tokens behind the leading ones, cut into min(PARTS, how many) runs of as equal length as can be; none if there are none."""
    many = F.size(tokens) - DEPTH
    cut = F.least(many, F.lit(PARTS))
    begin = lambda g: F.floor(g * many / cut).cast("int")
    runs = F.when(many > 0, F.sequence(F.lit(0), cut - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda g: F.xxhash64(F.slice(tokens, begin(g) + DEPTH + 1, begin(g + 1) - begin(g))))


def parsed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (a hash of id and text), id, line (its number from 0), own (a hash of it all), leaf and parts of each line that is not blank.

    The tree has a fixed depth: token count, then the DEPTH leading tokens, or all of a shorter line, which then has no
    parts and only equals lines that are the same; a leaf is a hash of that path. A row is
    small however long its line is. A line's tokens come out of a generator, which computes them once whatever is made
    of them; a document's text does not go along with its lines.
    """
    text = text_of(text_col)
    whole = docs.select(F.xxhash64(F.col(id_col), text).alias("doc"), F.col(id_col).alias("id"), F.split(text, "\n").alias("lines"))
    lines = whole.select("doc", "id", F.posexplode("lines").alias("line", "content"))
    cut = lines.select("doc", "id", "line", F.explode(F.array(tokens_of(F.col("content")))).alias("tokens")).filter(F.get("tokens", F.lit(0)) != "")
    path = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))
    placed = cut.select("doc", "id", "line", path.alias("leaf"), F.explode(F.array(_parts(F.col("tokens")))).alias("parts"))
    return placed.select("doc", "id", "line", F.xxhash64("leaf", "parts").alias("own"), "leaf", "parts")


def _masks(alike: float) -> dict[int, list[tuple[int, ...]]]:
    """For each number of parts, the sets of places that stay constant when as many others as `alike` lets are left open."""
    opened = lambda n: min(n, math.ceil((1 - alike) * (DEPTH + n) - 1e-9) - 1)
    return {n: list(combinations(range(n), n - opened(n))) for n in range(1, PARTS + 1) if opened(n) > 0}


def _templates(leaf: Column, parts: Column, alike: float) -> Column:
    """mask, template of all templates that a line can have, one for each set of constant places; none where no place can be open."""
    out = F.array().cast("array<struct<mask:int,template:bigint>>")
    for n, masks in _masks(alike).items():
        keys = [F.struct(F.lit(bits(m)).alias("mask"), F.xxhash64(leaf, F.lit(bits(m)), *(F.get(parts, F.lit(i)) for i in m)).alias("template")) for m in masks]
        out = F.when(F.size(parts) == n, F.array(*keys)).otherwise(out)
    return out


def bits(places: tuple[int, ...]) -> int:
    return sum(1 << i for i in places)


def recurring_lines(lines: DataFrame, alike: float = ALIKE) -> DataFrame:
    """doc, id, line of each line whose template occurs in two or more documents, but for the template's first occurrence.

    Lines of a leaf that agree in more than `alike` of their leading tokens and parts, at the same places, share a template; the other
    places are its variable fields, whatever values recur in them. Lines repeated verbatim are members like others. Of the
    templates of two or more documents that it shares with other lines, a line belongs to the one with most different lines (of equal ones that
    with the larger mask); a line that shares none is a template of its own. Each line has one template, so that the first
    occurrence of each stays: the one with the smallest id, then line.

    Every table that is joined is written first, so that both sides of a join are plain exchanges, of which a hot leaf, line or template is split.
    """
    # Equal lines become one row with their first and last document, so a hot line is one row from here on.
    ends = [F.min("a").alias("a"), F.max("b").alias("b")]
    span = [*ends, F.min("first").alias("first")]
    seen = lines.select("own", "leaf", F.col("doc").alias("a"), F.col("doc").alias("b"), F.struct("id", "doc", "line").alias("first"))
    same = written(seen.groupBy("own").agg(F.min("leaf").alias("leaf"), *span), "line-groups")

    # Only a leaf that holds different lines, of two or more documents, can hold a template of several: few lines' parts have to move.
    shared = written(same.groupBy("leaf").agg(*ends, F.count("*").alias("many")).filter("a <> b AND many > 1").select("leaf"), "line-leaves")
    inside = may_hold(lines.select("own", "leaf", "parts", "doc"), "leaf", shared).filter("again").join(shared, "leaf", "left_semi")
    held = inside.groupBy("own").agg(F.min("leaf").alias("leaf"), F.first("parts").alias("parts"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    keys = held.select("own", "a", "b", F.explode(_templates(F.col("leaf"), F.col("parts"), alike)).alias("t")).select("own", "a", "b", "t.*")
    keys = written(keys, "line-keys")
    common = written(keys.groupBy("template").agg(*ends, F.count("*").alias("many")).filter("many > 1 AND a <> b").select("template", "many"), "line-templates")
    best = keys.select("own", "mask", "template").join(common, "template").groupBy("own").agg(F.max(F.struct("many", "mask", "template")).alias("best"))
    best = written(best.select("own", F.col("best.template").alias("template")), "line-choices")

    # A line without company can recur by itself alone.
    told = written(same.join(best, "own", "left").filter("template IS NOT NULL OR a <> b").select("own", F.coalesce("template", "own").alias("template"), "a", "b", "first"), "line-told")
    groups = written(told.groupBy("template").agg(*span).filter("a <> b").select("template", F.col("first").alias("kept")), "line-recurring")
    found = written(told.select("own", "template").join(groups, "template").select("own", "kept"), "line-drops")
    again = may_hold(lines.select("own", "doc", "id", "line"), "own", found).filter("again")
    return again.join(found, "own").filter(F.struct("id", "doc", "line") != F.col("kept")).select("doc", "id", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with lines of recurring templates dropped: row (a struct of all its columns), text, n_lines, n_dropped.

    Lines are what line feeds separate. Blank lines stay. Of a template that two or more documents have, the first occurrence stays, so
    that nothing is lost from the corpus as a whole. Only hashes of lines are grouped. A Bloom filter of the documents that lose lines,
    bounded in size, is broadcast; texts that miss it stay where they are, and only those that hit it move, once, to
    meet the numbers of their dropped lines.

    Null texts count as empty and come back as empty. Null ids come before all others. Rows with the same id and text
    are one document, each of which gives a row; rows with the same id and different texts are documents of their own. A document may
    lose all lines. A text may be of any length; its lines are hashed where it lies. Columns of docs may have any names, as they come back inside
    `row` alone. An empty table gives an empty one.
    """
    with Scope() as scope:
        lines = written(parsed_lines(docs, id_col, text_col), "lines")
        drops = recurring_lines(lines).groupBy("doc", "id").agg(F.collect_set("line").alias("dropped"))
        drops = scope.kept(drops.withColumnRenamed("doc", "drop_doc"), "line-numbers")
    text = text_of(text_col)
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), text).alias("doc"), F.col(id_col).alias("own_id"), text.alias("text"))

    hit = may_hold(whole, "doc", drops.select(F.col("drop_doc").alias("doc")))
    all_lines = F.split("text", "\n")
    whole_rows = hit.filter("NOT again").select("row", "text", F.size(all_lines).alias("n_lines"), F.lit(0).alias("n_dropped"))

    # By merge at every size, so that a plan over a small table is that over a large one.
    met = hit.filter("again").select("row", "doc", "own_id", "text").join(drops.hint("merge"), (F.col("doc") == F.col("drop_doc")) & F.col("own_id").eqNullSafe(F.col("id")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stays, lambda i: F.get("all_lines", i)), "\n")
    cut = met.select("row", "text", "dropped", F.explode(F.array(all_lines)).alias("all_lines"))  # a generator, so that they are cut once
    return whole_rows.unionByName(cut.select("row", kept.alias("text"), F.size("all_lines").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped")))


def oracle(alike: float = ALIKE) -> str:
    """DuckDB SQL for dedup_lines(): the same tree and masks, over the tokens themselves in place of hashes."""
    masks = ", ".join(f"({n}, {bits(m)}, {[i + 1 for i in m]})" for n, own in _masks(alike).items() for m in own)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
cut AS (
  SELECT doc_id, line, list_filter(string_split_regex(regexp_replace(content, '{FIELD}', '{FIELD_MARK}', 'g'), '{GAP}'), lambda x: x <> '') AS tokens
  FROM (SELECT doc_id, unnest(all_lines) AS content, generate_subscripts(all_lines, 1) - 1 AS line FROM docs)),
pathed AS (SELECT *, [len(tokens)::VARCHAR] || tokens[:{DEPTH}] AS leaf, tokens[{DEPTH + 1}:] AS rest, greatest(least(len(tokens) - {DEPTH}, {PARTS}), 0) AS n FROM cut WHERE len(tokens) > 0),
lines AS MATERIALIZED (
  SELECT doc_id, line, leaf, list_transform(range(n), lambda g: array_to_string(rest[(g * len(rest)) // n + 1:((g + 1) * len(rest)) // n], ' ')) AS parts FROM pathed),
same AS MATERIALIZED (SELECT leaf, parts, min(doc_id) AS a, max(doc_id) AS b, min([doc_id, line]) AS first, row_number() OVER () AS own FROM lines GROUP BY 1, 2),
masks(n, mask, places) AS (VALUES {masks}),
keys AS MATERIALIZED (SELECT own, a, b, leaf, mask, list_transform(places, lambda i: parts[i]) AS constant FROM same JOIN masks ON n = len(parts)),
common AS (SELECT leaf, mask, constant, count(*) AS many FROM keys GROUP BY 1, 2, 3 HAVING count(*) > 1 AND min(a) <> max(b)),
best AS (
  SELECT own, leaf, mask, constant FROM (SELECT own, k.leaf, k.mask, k.constant, row_number() OVER (PARTITION BY own ORDER BY many DESC, k.mask DESC) AS nth
  FROM keys k JOIN common c ON k.leaf = c.leaf AND k.mask = c.mask AND k.constant = c.constant) WHERE nth = 1),
told AS MATERIALIZED (SELECT s.own, s.a, s.b, s.first, s.leaf, coalesce(mask, -1) AS mask, coalesce(constant, s.parts) AS constant FROM same s LEFT JOIN best USING (own) WHERE mask IS NOT NULL OR a <> b),
groups AS (SELECT leaf, mask, constant, min(first) AS kept FROM told GROUP BY 1, 2, 3 HAVING min(a) <> max(b)),
found AS (SELECT own, kept FROM told t JOIN groups g ON t.leaf = g.leaf AND t.mask = g.mask AND t.constant = g.constant),
drops AS (SELECT doc_id, list(line) AS dropped FROM lines JOIN same USING (leaf, parts) JOIN found USING (own) WHERE [doc_id, line] <> kept GROUP BY 1)
SELECT doc_id, len(all_lines)::INT AS n_lines, coalesce(len(dropped), 0)::INT AS n_dropped,
       sha256(CASE WHEN dropped IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(all_lines)), lambda i: NOT list_contains(dropped, i)), lambda i: all_lines[i + 1]), chr(10)), '') END) AS text_sha256
FROM docs LEFT JOIN drops USING (doc_id)
"""
