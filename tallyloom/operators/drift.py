"""Schemas that drift between files: one consistent table from files whose columns change, and every change.

Lines become path-value maps (file, line, place -> raw text); statistics of the values by file and
path give each column its kind; each file's columns are compared with those of the file written
before it in the same feed; typed columns are projected with a report of the casts that failed.

Defined results: a file without a header line takes no part; values beyond the header's width are
ignored; a column without any non-blank value has no kind and is never ``retyped``; of columns with
one name in a file the first counts; files of one feed written at the same moment are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.rejects import trimmed

_FIELD = r'(?s)("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+),'
WHOLE = r"\A[+-]?[0-9]++\z"
NUMBER = r"\A[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"
TRUTH = r"(?i)\A(?:true|false)\z"

#: the places a consistent table gives to the names that files use; a caller may pass its own
SYNONYMS = {
    "question_number": ["question_number", "question_id", "item_number", "qnum", "q_no"],
    "choice": ["option", "answer", "choice", "letter", "selected"],
    "reason": ["reason", "why", "rationale", "justification", "explanation"],
    "latency_s": ["latency_s", "elapsed", "duration"],
}
#: letters before a number and a unit after it are no part of its value
AFFIX = r"\A\p{L}++(?=[0-9])|(?<=[0-9])\s*+\p{L}++\z"
TYPES = {"question_number": "bigint", "choice": "string", "reason": "string", "latency_s": "double"}


def fields(line: Column) -> Column:
    """The fields of a comma-separated line, quotes taken off."""
    raw = F.regexp_extract_all(F.concat(F.regexp_replace(line, r"\A\x{FEFF}", ""), F.lit(",")), F.lit(_FIELD), F.lit(1))
    return F.transform(
        raw,
        lambda x: F.when(x.rlike(r'(?s)\A".*+') & x.endswith('"') & (F.length(x) >= 2), F.regexp_replace(F.regexp_replace(x, r'\A"|"\z', ""), '""', '"')).otherwise(x),
    )


def column_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s\x{FEFF}]++", ""))


def path_values(lines: DataFrame) -> DataFrame:
    """file_id, line_no, place, name, value: the long form of all files."""
    header = (
        lines.where("line_no = 0").groupBy("file_id").agg(F.min("line").alias("header"))
        .select("file_id", F.transform(fields(F.col("header")), column_name).alias("names"))
    )
    body = lines.where("line_no > 0").select("file_id", "line_no", fields(F.col("line")).alias("values"))
    return (
        body.join(header, "file_id")
        .select("file_id", "line_no", F.posexplode(F.arrays_zip("names", "values")).alias("place", "cell"))
        .select("file_id", "line_no", "place", F.col("cell.names").alias("name"), trimmed(F.col("cell.values")).alias("value"))
        .where("name is not null")
    )


def columns_by_file(lines: DataFrame) -> DataFrame:
    """file_id, cols: array of (place, name, kind) in the order of the places."""
    header = (
        lines.where("line_no = 0").groupBy("file_id").agg(F.min("line").alias("header"))
        .select("file_id", F.posexplode(F.transform(fields(F.col("header")), column_name)).alias("place", "name"))
    )
    filled = F.col("value") != ""
    kinds = path_values(lines).where(filled).groupBy("file_id", "place").agg(
        F.bool_and(F.col("value").rlike(WHOLE)).alias("whole"),
        F.bool_and(F.col("value").rlike(NUMBER)).alias("number"),
        F.bool_and(F.col("value").rlike(TRUTH)).alias("truth"),
    )
    kind = F.when(F.col("whole"), "whole").when(F.col("number"), "number").when(F.col("truth"), "truth").when(F.col("whole").isNotNull(), "text")
    return (
        header.join(kinds, ["file_id", "place"], "left")
        .groupBy("file_id", "name").agg(F.min(F.struct("place", kind.alias("kind"))).alias("c"))
        .groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(F.col("c.place").alias("place"), "name", F.col("c.kind").alias("kind")))).alias("cols"))
    )


def changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, change_kind, old_name, new_name against the file of the feed written before."""
    order = Window.partitionBy("feed_id").orderBy("written_at", "file_id")
    seen = (
        files.select("file_id", "feed_id", "written_at").join(columns_by_file(lines), "file_id")
        .select("file_id", "cols", F.lag("cols").over(order).alias("old")).where("old is not null")
    )
    name = lambda x: x["name"]
    gone = F.filter("old", lambda o: ~F.array_contains(F.transform("cols", name), o["name"]))
    come = F.filter("cols", lambda n: ~F.array_contains(F.transform("old", name), n["name"]))
    seen = seen.withColumn("gone", gone).withColumn("come", come)
    renamed = "filter(transform(gone, g -> struct(g as o, get(filter(come, c -> c.place = g.place), 0) as n)), p -> p.n is not null)"
    kept = "transform(filter(old, o -> exists(cols, c -> c.name = o.name)), o -> struct(o as o, get(filter(cols, c -> c.name = o.name), 0) as n))"
    change = lambda kind, old, new: f"struct('{kind}' as change_kind, {old} as old_name, {new} as new_name)"
    return (
        seen.withColumn("renamed", F.expr(renamed)).withColumn("both", F.expr(f"concat(renamed, {kept})"))
        .select(
            "file_id",
            F.explode(
                F.expr(
                    f"concat(transform(renamed, p -> {change('renamed', 'p.o.name', 'p.n.name')}),"
                    f" transform(filter(gone, g -> not exists(renamed, p -> p.o.place = g.place)), g -> {change('removed', 'g.name', chr(39) * 2)}),"
                    f" transform(filter(come, c -> not exists(renamed, p -> p.n.place = c.place)), c -> {change('added', chr(39) * 2, 'c.name')}),"
                    f" transform(filter(both, p -> p.o.kind <> p.n.kind), p -> {change('retyped', 'p.o.name', 'p.n.name')}))"
                )
            ).alias("c"),
        )
        .select("file_id", "c.change_kind", "c.old_name", "c.new_name")
    )


def _first_of_names(cells: Column) -> Column:
    """(target, value) of sorted (place, target, value) cells; of equal names the first place counts."""
    first = F.filter(cells, lambda e, i: ~F.exists(F.slice(cells, F.lit(1), i), lambda before: before["target"] == e["target"]))
    return F.transform(first, lambda e: F.struct(e["target"], e["value"]))


def unified(files: DataFrame, lines: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS, types: dict[str, str] = TYPES) -> DataFrame:
    """One row for each data line: file_id, line_no, the typed columns, all other columns as a map, the names of failed casts.

    Of several names of one column in a file the first in the declared order that holds a value counts; the
    others stay among the other columns under their own names, and so does a value whose cast fails.
    """
    order = {n: (to, i) for to, names in synonyms.items() for i, n in enumerate(names)}
    target = F.create_map(*[F.lit(x) for n, (to, _) in order.items() for x in (n, to)])
    rank = F.create_map(*[F.lit(x) for n, (_, i) in order.items() for x in (n, i)])
    named = F.col("name")
    cell = path_values(lines).withColumn("target", F.coalesce(target[named], named)).withColumn("rank", rank[named]).withColumn("value", F.nullif("value", F.lit("")))
    raw = {t: F.min(F.when((F.col("target") == t) & F.col("rank").isNotNull() & F.col("value").isNotNull(), F.struct("rank", "place", "name", "value"))).alias(f"raw_{t}") for t in synonyms}
    other = F.collect_list(F.struct("place", F.col("name").alias("target"), "value", F.col("rank").isNotNull().alias("known")))
    rows = cell.groupBy("file_id", "line_no").agg(*raw.values(), F.sort_array(other).alias("cells"))
    typed = {t: F.expr(f"try_cast(regexp_replace(raw_{t}.value, r'{AFFIX}', '') as {types[t]})") if types[t] != "string" else F.col(f"raw_{t}.value") for t in synonyms}
    taken = F.array_compact(F.array(*[F.when(typed[t].isNotNull(), F.col(f"raw_{t}.name")) for t in synonyms]))
    others = F.filter("cells", lambda c: ~c["known"] | (c["value"].isNotNull() & ~F.array_contains(taken, c["target"])))
    failed = F.array_compact(F.array(*[F.when(F.col(f"raw_{t}").isNotNull() & typed[t].isNull(), F.lit(t)) for t in synonyms]))
    return rows.join(files.select("file_id", "feed_id", "run", "corpus"), "file_id").select(
        "file_id", "line_no", "feed_id", "run", "corpus", *[c.alias(t) for t, c in typed.items()], F.map_from_entries(_first_of_names(others)).alias("others"), failed.alias("failed_casts")
    )


def statistics(lines: DataFrame) -> DataFrame:
    """file_id, name, n_values, n_blank, n_whole, n_number, n_truth: the path statistics behind the kinds."""
    n = lambda c: F.count(F.when(c, 1))
    return path_values(lines).groupBy("file_id", "name").agg(
        F.count("value").alias("n_values"), n(F.col("value") == "").alias("n_blank"), n(F.col("value").rlike(WHOLE)).alias("n_whole"),
        n(F.col("value").rlike(NUMBER)).alias("n_number"), n(F.col("value").rlike(TRUTH)).alias("n_truth"),
    )
