"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import copies, leakage, mojibake, nearcopies, packing, pairs, scans, truncation
from tallyloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken(table(spark, d, "predictions_option"), table(spark, d, "predictions_answer"), table(spark, d, "questions_block"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_pairs(table(spark, d, "questions_block"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_groups(table(spark, d, "questions_block"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    explained, blocks = table(spark, d, "explained_items"), table(spark, d, "format_blocks")
    return scans.fields(
        [
            ("explained_items", explained, "explained_id", "question", "pdf_name"),
            ("explained_items", explained, "explained_id", "option_a", "pdf_name"),
            ("format_blocks", blocks, "block_id", "stem", "pdf_name"),
        ]
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(_scanned(spark, d))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_scanned(spark, d))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return truncation.replies(table(spark, d, "predictions_option"), table(spark, d, "predictions_answer"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(_replies(spark, d), "pred_id", "reason")


def p6_share_by_run(spark: SparkSession, d: str) -> DataFrame:
    texts = _replies(spark, d)
    return truncation.share_by_run(texts, truncation.cut_texts(texts, "pred_id", "reason"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "questions_block"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "questions_block")).select("item_id", "corpus", "question_number", "stem", "n_copies")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_pack(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "public_items"))


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    documents, items = table(spark, d, "documents"), table(spark, d, "public_items")
    return leakage.leaked_items(leakage.leaks(documents, items), documents, items)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_groups, p3_found, p3_repaired, p6_found, p6_share_by_run, p7_found, p7_collapsed, p8_pack, p8_report, p9_found, p9_leaked_items, p10_found, p10_restored,
    )
}

_KEYED = r"""
  keyed as (
    select item_id, corpus, question_number, stem,
           regexp_replace(lower(coalesce(stem, '')), '[^\p{L}\p{N}]+', '', 'g') as s,
           list_sort([regexp_replace(lower(v), '[^\p{L}\p{N}]+', '', 'g') for v in map_values(choices) if v is not null]) as c
    from questions_block),
  grouped as (select s, c, min(item_id) as kept_id, count(*) as n_copies from keyed group by s, c)
"""
_PAIRS = r"""
  fields as (
    select item_id, unnest(list_concat([stem], map_values(choices))) as f from questions_block),
  worded as (select item_id, regexp_extract_all(lower(f), '[\p{L}\p{N}]+') as w from fields where f is not null),
  members as (
    select distinct item_id, unnest(case when len(w) <= 1 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as m from worded),
  sizes as (select item_id, count(*) as n from members group by item_id)
"""
_LEAKS = """
  q as (select id, regexp_extract_all(lower(question), '[a-z0-9]+') as w from public_items),
  qr as (select distinct id, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) as r from q),
  t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
  tr as (select distinct doc_id, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) as r from t),
  found as (select distinct doc_id, id from tr join qr using (r))
"""

ORACLE: dict[str, str] = {
    "p2_found": f"""with {_KEYED}, {_PAIRS},
      shared as (select a.item_id as x, b.item_id as y, count(*) as k from members a join members b on a.m = b.m and a.item_id < b.item_id group by all)
      select x as item_id_a, y as item_id_b from shared join sizes sx on x = sx.item_id join sizes sy on y = sy.item_id
      join keyed kx on x = kx.item_id join keyed ky on y = ky.item_id
      where 1.0 * k / (sx.n + sy.n - k) >= 0.6 and (kx.s, kx.c) <> (ky.s, ky.c)""",
    "p7_found": f"""with {_KEYED}
      select kept_id, item_id as copy_id from keyed join grouped using (s, c) where item_id <> kept_id""",
    "p7_collapsed": f"""with {_KEYED}
      select k.item_id, k.corpus, k.question_number, k.stem, g.n_copies from keyed k join grouped g on k.item_id = g.kept_id""",
    "p2_groups": f"""with {_KEYED}, {_PAIRS},
      classed as (select k.item_id, min(k.item_id) over (partition by s, c, m) as class_id, n from keyed k join (select item_id, list_sort(list(m)) as m, count(*) as n from members group by item_id) using (item_id)),
      rep as (select item_id, n from classed where item_id = class_id), held as (select item_id, m from members where item_id in (select item_id from rep)),
      shared as (select a.item_id as x, b.item_id as y, count(*) as k from held a join held b on a.m = b.m and a.item_id <> b.item_id group by all),
      linked as (select x, y from shared join rep sx on x = sx.item_id join rep sy on y = sy.item_id where 1.0 * k / (sx.n + sy.n - k) >= 0.6)
      select item_id, class_id, y as linked_class from classed left join linked on item_id = class_id and x = class_id""",
    "p9_found": f"with {_LEAKS} select doc_id, id from found",
    "p9_leaked_items": f"""with {_LEAKS},
      b as (select doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' as body from documents),
      a as (select id, [x for x in [' ' || trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) || ' ' for c in choices] if length(x) > 2] as answers from public_items)
      select id, count(distinct doc_id) as n_documents, count(distinct case when len([x for x in answers if contains(body, x)]) > 0 then doc_id end) as n_with_choice
      from found join a using (id) join b using (doc_id) group by id""",
}
