"""Queries of the evaluation operators over the driver's tables, each over whole tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import parsing, replies, rules, similarity, text
from tallyloom.functions.tables import MODEL_SIZES, TOPIC_KEYWORDS
from tallyloom.operators import balance, cards, dedupe, joins, judging, modelcall, roadmap, scoring
from tallyloom.schema import BUCKETS
from tallyloom.session import cut, table
from tallyloom.sources import blocks, documents, keys, sinks
from tallyloom.streaming import run_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CORPORA = ["from_pdf_cards", "from_video", "synthetic"]
def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- shared frames and their SQL ---------------------------------------------------------------------------


def _option(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "predictions_option")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions_block")


def _gold(s: SparkSession, d: str) -> DataFrame:
    return scoring.gold_key(table(s, d, "answers"))


def _letters(s: SparkSession, d: str) -> DataFrame:
    return scoring.all_letters(_option(s, d), table(s, d, "predictions_answer"))


def _buckets(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("corpus", "question_number", (F.pmod("question_number", F.lit(8)) + 1).cast("int").alias("bucket"))


def _accuracy(s: SparkSession, d: str) -> DataFrame:
    return scoring.run_accuracy(_letters(s, d), _gold(s, d))


def _long(s: SparkSession, d: str) -> DataFrame:
    letters = _letters(s, d)
    return scoring.dense(scoring.bucket_accuracy(letters, _gold(s, d), _buckets(s, d)), letters)


def _values(c: str = "choices") -> F.Column:
    return F.map_values(c)


_GOLD = """gold as (select corpus, question_number, arg_max(l, row(keyed_at, l)) as gold from (select *, upper(trim(answer)) as l from answers)
  where l in ('A','B','C','D') group by corpus, question_number)"""
_LETTERS = """letters as (select corpus, run, question_number, arg_max(l, row(answered_at, pred_id)) as letter from (
    select corpus, run, question_number, upper(trim(option)) as l, answered_at, pred_id from predictions_option
    union all select corpus, run, question_number, upper(trim(answer)), answered_at, pred_id from predictions_answer)
  where l in ('A','B','C','D') group by corpus, run, question_number)"""
_ACC = """acc as (select corpus, run, count(*) as compared, count(*) filter (letter = gold) as correct, count(*) filter (letter <> gold) as wrong,
    round_even(count(*) filter (letter = gold)::double * 100 / count(*), 2) as pct
  from letters join gold using (corpus, question_number) group by corpus, run)"""
_DIM = f"dim as (select * from (values {', '.join(f'({i}, {chr(39)}{name}{chr(39)})' for i, name in BUCKETS)}) t(bucket, bucket_name))"
_LONG = f"""{_GOLD}, {_LETTERS}, {_DIM},
  b as (select corpus, question_number, question_number % 8 + 1 as bucket from questions_block),
  stats as (select corpus, run, bucket, count(*) as n, count(*) filter (letter = gold) as correct from letters join gold using (corpus, question_number) join b using (corpus, question_number) group by all),
  long as (select r.corpus, r.run, d.bucket, d.bucket_name, coalesce(n, 0)::bigint as n, coalesce(correct, 0)::bigint as correct,
      case when n > 0 then round_even(correct::double / n, 5) end as accuracy
    from (select distinct corpus, run from letters) r cross join dim d left join stats s on s.corpus = r.corpus and s.run = r.run and s.bucket = d.bucket)"""


# --- scoring ------------------------------------------------------------------------------------------------


@query(f"with {_GOLD}, {_LETTERS}, {_ACC} select * from acc")
def run_accuracy(s, d):
    return _accuracy(s, d)


@query(f"with {_LONG} select * from long")
def bucket_accuracy_dense(s, d):
    return _long(s, d)


@query(f"""with {_LONG} select corpus, run, arg_max(bucket, row(accuracy, -bucket)) as best_bucket, max(accuracy) as best_accuracy,
  arg_min(bucket, row(accuracy, bucket)) as worst_bucket, min(accuracy) as worst_accuracy from long where accuracy is not null group by corpus, run""")
def best_worst_bucket(s, d):
    return scoring.best_and_worst(_long(s, d))


@query(f"with {_LONG} select corpus, bucket, round_even(avg(accuracy), 5) as mean_accuracy, count(accuracy) as n_rates from long group by corpus, bucket")
def mean_by_bucket(s, d):
    return scoring.mean_rates(_long(s, d), ["corpus", "bucket"])


@query(f"with {_LONG} select corpus, run, round_even(avg(accuracy), 5) as mean_accuracy, count(accuracy) as n_rates from long group by corpus, run")
def mean_by_run(s, d):
    return scoring.mean_rates(_long(s, d), ["corpus", "run"])


@query(f"""with {_GOLD}, {_LETTERS}, {_ACC},
  fam as (select regexp_replace(regexp_replace(run, '_reasoned_from_.*$', ''), '(_(reasoned|two_phase|synthetic_data))+$', '') as family, corpus, avg(pct) as p from acc group by 1, 2)
  select family, round_even(max(p) filter (corpus = 'from_pdf_cards'), 2) as from_pdf_cards, round_even(max(p) filter (corpus = 'from_video'), 2) as from_video,
    round_even(max(p) filter (corpus = 'synthetic'), 2) as synthetic, round_even(avg(p), 2) as mean_pct from fam group by family""")
def mean_by_family(s, d):
    return scoring.family_means(_accuracy(s, d), CORPORA)


@query(f"""with {_GOLD}, {_LETTERS}, {_ACC} select *, row_number() over (partition by corpus order by pct desc, run)::int as rank from acc""")
def leaderboard(s, d):
    return scoring.leaderboard(_accuracy(s, d), ["corpus"], "pct", "run")


@query(f"""with {_LONG}, j as (select * from letters join gold using (corpus, question_number) join b using (corpus, question_number))
  select corpus, run, bucket, grouping(corpus, run, bucket)::bigint as level, count(*) as n, count(*) filter (letter = gold) as correct
  from j group by grouping sets ((corpus, run, bucket), (corpus, run), (corpus))""")
def accuracy_rollup(s, d):
    return scoring.accuracy_rollup(_letters(s, d), _gold(s, d), _buckets(s, d))


@query(f"with {_GOLD} select * from gold")
def last_wins(s, d):
    return _gold(s, d)


@query(f"""with {_GOLD}, q as (select distinct corpus, question_number from questions_block),
  f as (select coalesce(q.corpus, gold.corpus) as corpus, q.question_number as a, gold.question_number as b from q full join gold on q.corpus = gold.corpus and q.question_number = gold.question_number)
  select corpus, count(*) filter (b is null) as unanswered, count(*) filter (a is null) as unasked, count(*) filter (a is null or b is null) as mismatch from f group by corpus""")
def key_coverage(s, d):
    return scoring.coverage(_questions(s, d), _gold(s, d))


@query(f"with {_GOLD} select distinct corpus, question_number from questions_block q where not exists (select 1 from gold g where g.corpus = q.corpus and g.question_number = q.question_number)")
def missing_keys(s, d):
    return scoring.missing_keys(_questions(s, d), _gold(s, d))


def _public_predictions(s, d):
    """Two runs of replies to the held-out items, from the digits of their ids; no letter for some."""
    items = table(s, d, "public_items")
    digit = lambda k: F.pmod(F.conv(F.substring("id", k, 1), 16, 10).cast("int"), F.lit(5))
    one = lambda name, k: items.select(F.lit(name).alias("run"), "id", F.when(digit(k) < 4, digit(k)).alias("pred_index"))
    return one("first", 4).unionByName(one("second", 5))


@query("""with p as (select 'first' as run, id, ('0x' || id[4])::int % 5 as i from public_items union all select 'second', id, ('0x' || id[5])::int % 5 from public_items)
  select run, count(*) as total, count(*) filter (i = correct_index) as correct, round_even(count(*) filter (i = correct_index)::double / count(*), 6) as accuracy
  from p join item_labels using (id) group by run""")
def cli_accuracy_null_is_wrong(s, d):
    return scoring.labelled_accuracy(table(s, d, "public_items"), _public_predictions(s, d), table(s, d, "item_labels"))


@query("""select 'constant' as run, count(*) as total, count(*) filter (correct_index = 0) as correct, round_even(count(*) filter (correct_index = 0)::double / count(*), 6) as accuracy
  from item_labels where id in (select id from public_items)""")
def dry_run_baseline(s, d):
    return scoring.constant_baseline(table(s, d, "public_items"), table(s, d, "item_labels"))


@query(f"""with {_GOLD}, {_LETTERS} 
  select *, round_even(n::double / sum(n) over (partition by corpus, run), 5) as share from (select corpus, run, letter, count(*) as n from letters group by all)""")
def letter_distribution(s, d):
    return roadmap.letter_distribution(_letters(s, d), ["corpus", "run"])


@query(f"""with {_GOLD}, {_LETTERS}, c as (select corpus, question_number, letter, count(*) as votes from letters group by all)
  select corpus, question_number, arg_max(letter, row(votes, -ascii(letter))) as letter, arg_max(votes, row(votes, -ascii(letter))) as votes, sum(votes)::bigint as voters from c group by all""")
def majority_vote(s, d):
    return roadmap.majority(_letters(s, d), ["corpus", "question_number"], "letter")


@query(f"""with {_GOLD}, {_LETTERS}, {_ACC}, l as (select run, date_diff('microsecond', answered_at, loaded_at) / 1e6 as x from predictions_option)
  select corpus, run, compared, correct, wrong, pct, (select round(round_even(avg(x), 3), 0) from l where l.run = acc.run) as mean_latency, pct >= 30 as passed from acc""")
def run_verdict(s, d):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("loaded_at") - micros("answered_at")) / 1e6
    latency = _option(s, d).select("run", seconds.alias("latency_s"))
    return roadmap.run_verdict(_accuracy(s, d), latency, 30.0).withColumn("mean_latency", F.round("mean_latency_s", 0)).drop("mean_latency_s")


# --- judging ------------------------------------------------------------------------------------------------


def _judged(s, d):
    replies = _option(s, d).select("run", "corpus", "question_number", F.col("option").alias("model_option"), text.clamped((F.length("reason") % 6 - 1).cast("string"), 0, 3).alias("alignment_score"))
    return judging.records(judging.eligible(replies, _questions(s, d)), _gold(s, d))


_JUDGED = f"""{_GOLD}, judged as (select p.run, coalesce(upper(trim(option)) in ('A','B','C','D') and upper(trim(option)) = gold, false) as ok,
    greatest(0, least(3, coalesce(length(reason) % 6 - 1, 0))) as score
  from predictions_option p left join gold g on g.corpus = p.corpus and g.question_number = p.question_number
  where exists (select 1 from questions_block q where q.corpus = p.corpus and q.question_number = p.question_number))"""


@query(f"""with {_JUDGED} select run, count(*) as n_scored, round_even(count(*) filter (ok)::double / count(*), 4) as accuracy, round_even(avg(score), 4) as avg_alignment_score,
  {', '.join(f"round_even(count(*) filter (score = {i})::double / count(*), 4) as pct_score_{i}" for i in range(4))} from judged group by run""")
def judge_summary(s, d):
    return judging.summary(_judged(s, d))


@query(f"with {_JUDGED} select run, round_even(coalesce(avg(score) filter (ok), 0), 4) as mean_when_correct, round_even(avg(score), 4) as mean_alignment from judged group by run")
def conditional_mean_score(s, d):
    return judging.conditional_means(_judged(s, d))


# --- buckets, balance, windows ------------------------------------------------------------------------------


def _topic(s, d):
    blob = text.spaced(F.concat_ws(" ", F.coalesce("stem", F.lit("")), _values()))
    return _questions(s, d).select("item_id", rules.tagged_match(blob, TOPIC_KEYWORDS, 1).alias("x")).select("item_id", "x.bucket", "x.tag")


_CASE = lambda k: "case " + " ".join(f"when {' or '.join(f'contains(t, $${w}$$)' for w in r[2])} then {r[0] if k == 'bucket' else chr(39) + r[1] + chr(39)}" for r in TOPIC_KEYWORDS) + (" else 1 end" if k == "bucket" else " else 'default' end")
_TOPIC = f"""topic as (select item_id, {_CASE('bucket')} as bucket, {_CASE('tag')} as tag from (
  select item_id, trim(regexp_replace(lower(coalesce(stem, '') || ' ' || array_to_string(map_values(choices), ' ')), '[^a-z0-9]+', ' ', 'g')) as t from questions_block))"""


@query(f"with {_TOPIC} select * from topic")
def keyword_buckets(s, d):
    return _topic(s, d)


@query(f"with {_TOPIC}, {_DIM} select d.bucket, d.bucket_name, count(item_id) as n from dim d left join topic using (bucket) group by all")
def bucket_histogram(s, d):
    return balance.histogram(_topic(s, d))


@query(f"""with {_TOPIC}, {_DIM}, h as (select d.bucket, count(item_id) as n from dim d left join topic using (bucket) group by all)
  select bucket, n as have, least(n, 100)::bigint as keep, greatest(0, 100 - n)::bigint as generate, (sum(greatest(0, 100 - n)) over ())::bigint as total from h""")
def bucket_deficit_plan(s, d):
    return balance.deficit_plan(_topic(s, d), 100)


def _size_sql() -> str:
    met = lambda names, without: "(" + " or ".join(f"contains(r, '{n}')" for n in names) + ")" + "".join(f" and not contains(r, '{n}')" for n in without)
    return "case " + " ".join(f"when {met(names, without)} then '{v}'" for v, names, without in MODEL_SIZES) + " else '—' end"


@query(f"select run, {_size_sql()} as size from (select run, lower(run) as r from (select run from predictions_option union select run from predictions_answer))")
def parameter_sizes(s, d):
    runs = _option(s, d).select("run").union(table(s, d, "predictions_answer").select("run")).distinct()
    return runs.select("run", rules.first_of_names(F.lower("run"), MODEL_SIZES, "—").alias("size"))


@query("select deck, item_id, question_number from (select *, row_number() over (partition by deck order by question_number, item_id) as r from questions_block) where r <= 5")
def top_n_per_deck(s, d):
    return balance.first_of_each(_questions(s, d).select("deck", "item_id", "question_number"), ["deck"], [F.col("question_number"), F.col("item_id")], 5)


@query("select deck, item_id from (select *, row_number() over (partition by deck order by md5('42:' || item_id), item_id) as r from questions_block) where r <= 5")
def stratified_sample(s, d):
    return balance.sample_of_each(_questions(s, d).select("deck", "item_id"), ["deck"], "item_id", 5)


@query("""with b as (select item_id, ('0x' || left(md5(item_id::varchar), 7))::int % 100 as band from questions_block)
  select item_id, case when band < 10 then 'test' when band < 30 then 'validation' else 'train' end as split from b""")
def split_70_10_20(s, d):
    return _questions(s, d).select("item_id", balance.split_band(F.col("item_id")).alias("split"))


@query("""with k as (select pred_id, list_transform([length(reason), question_number, length(reason), question_number % 7, 3], lambda x: x % 12 + 0) as g from predictions_option),
  v as (select pred_id, list_filter(g, lambda x, i: x between 1 and 10 and list_position(g, x) = i) as v from k)
  select pred_id, list_sort((v || list_filter(range(1, 11), lambda x: not list_contains(v, x)))[1:5])::int[] as keep from v""")
def keep_list_normalise(s, d):
    rows = _option(s, d)
    raw = F.transform(F.array(F.length("reason"), "question_number", F.length("reason"), F.col("question_number") % 7, F.lit(3)), lambda x: (x % 12).cast("int"))
    return rows.select("pred_id", balance.keep_list(raw, 10, 5).alias("keep"))


@query("""with n as (select deck, question_number, row_number() over (partition by deck order by question_number) as r from questions_block)
  select deck, ((r - 1) // 10)::bigint as batch, list(question_number order by question_number) as members from n group by all""")
def minibatch(s, d):
    return balance.batches(_questions(s, d), "question_number", 10, ["deck"])


@query("select question_number, least(8, (question_number - 1) // 50 + 1)::int as bucket from (select unnest(range(1, 421))::int as question_number)")
def layout_buckets(s, d):
    return keys.layout(s, 420, 50)


# --- duplicates ---------------------------------------------------------------------------------------------

_SQ = "regexp_replace(lower(coalesce(stem, '')), '[^a-z0-9]+', '', 'g')"


@query(f"select item_id, stem from (select *, row_number() over (partition by {_SQ} order by item_id) as r, {_SQ} as k from questions_block) where r = 1 or k = ''")
def exact_dedupe(s, d):
    return dedupe.deduped(_questions(s, d).select("item_id", "stem"), "stem", "item_id")


@query(f"""select corpus, item_id, row_number() over (partition by corpus order by item_id)::int as new_number from (
  select *, row_number() over (partition by {_SQ} order by item_id) as r, {_SQ} as k from questions_block) where r = 1 or k = ''""")
def dedupe_renumber(s, d):
    kept = dedupe.deduped(_questions(s, d).select("corpus", "item_id", "stem"), "stem", "item_id")
    return dedupe.renumbered(kept, "item_id", ["corpus"]).select("corpus", "item_id", "new_number")


@query(r"""with k as (select item_id, left(trim(regexp_replace(lower(coalesce(stem, '') || '|' || coalesce(choices['A'], '') || '|' || coalesce(choices['B'], '')), '\s+', ' ', 'g')), 200) as key from questions_block)
  select item_id, item_id > min(item_id) over (partition by key) and key <> '' as is_duplicate from k""")
def composite_key_dedupe(s, d):
    key = dedupe.composite_key(F.col("stem"), F.col("choices")["A"], F.col("choices")["B"])
    return dedupe.flagged(_questions(s, d), key, "item_id").select("item_id", "is_duplicate")


@query(f"""with k as (select item_id, corpus, left({_SQ}, 160) as k from questions_block), f as (select * from k where corpus <> 'synthetic' and k not in (select k from k where corpus = 'synthetic' and k <> ''))
  select item_id from (select *, row_number() over (partition by k order by item_id) as r from f) where r = 1 or k = ''""")
def dedupe_against_accepted(s, d):
    q = _questions(s, d).select("item_id", "corpus", "stem")
    return dedupe.against_accepted(q.where("corpus <> 'synthetic'"), q.where("corpus = 'synthetic'"), "stem", "item_id").select("item_id")


def _duplicate_edges(s, d):
    q = _questions(s, d).select("item_id", text.squash(F.coalesce("stem", F.lit(""))).alias("k"), text.squash(F.coalesce(F.col("choices")["A"], F.lit(""))).alias("c")).where("k <> ''")
    by = lambda key: q.withColumn("g", key).join(q.groupBy(key.alias("g")).agg(F.min("item_id").alias("b")), "g").select(F.col("item_id").alias("a"), "b")
    return by(F.col("k")).union(by(F.left("k", F.lit(60)))).distinct()


@query(r"""with recursive q as (select item_id, regexp_replace(lower(coalesce(stem, '')), '[^a-z0-9]+', '', 'g') as k from questions_block where stem is not null),
  m as (select item_id, min(item_id) over (partition by left(k, 60)) as c from q where k <> '') select item_id as node, c as component from m""")
def duplicate_components(s, d):
    return dedupe.components(_duplicate_edges(s, d))


# --- parsing ------------------------------------------------------------------------------------------------


@query(r"""select pred_id, nullif(upper(regexp_extract(option, '(?i)(?:^|[^A-Za-z0-9_])([ABCD])(?:[^A-Za-z0-9_]|$)', 1)), '') as letter,
  nullif(instr('ABCD', nullif(upper(regexp_extract(option, '(?i)(?:^|[^A-Za-z0-9_])([ABCD])(?:[^A-Za-z0-9_]|$)', 1)), '')), 0)::int - 1 as letter_index from predictions_option""")
def first_letter_parse(s, d):
    letter = text.first_letter(F.col("option"))
    return _option(s, d).select("pred_id", letter.alias("letter"), text.letter_index(letter).alias("letter_index"))


_FORMS = [
    "concat('OPTION: ', o, chr(10), 'REASON: ', r)", "concat('Thinking.', chr(10), 'Answer: ', o, ' because ', r)", "concat('OPTION: A, B, C or D', chr(10), chr(10), 'reason: ', r, chr(10), 'ANSWER: ', o)",
    "concat('The correct answer is ', o, '. ', r)", "concat(r, chr(10), '(', o, ')')", "concat('A. none of the losses at all', chr(10), 'B. all of them', chr(10), o, ') ', r)", "r",
]
_FORM = f"case {' '.join(f'when pred_id % 7 = {i} then {f}' for i, f in enumerate(_FORMS))} end"


def _replied(s, d):
    """Replies in the seven forms that models give them."""
    raw = _option(s, d).selectExpr("pred_id", "corpus", "coalesce(option, '') as o", "coalesce(reason, '') as r")
    return raw.select("pred_id", "corpus", F.expr(_FORM).alias("reply"))


_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda x: rf"regexp_replace(regexp_replace({x}, '^{_BLANKS}+', ''), '{_BLANKS}+$', '')"
_LINES = rf"""replied as (select pred_id, corpus, {_FORM} as reply from (select pred_id, corpus, coalesce(option, '') as o, coalesce(reason, '') as r from predictions_option)),
  lined as (select *, {_strip('reply')} as whole, list_filter([{_strip('x')} for x in regexp_split_to_array(reply, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')], lambda x: x <> '') as l from replied)"""
_line_letter = lambda x: f"""case when regexp_matches({x}, '^[A-D]\\.\\s+.{{12,}}') and length({x}) > 50 then null else upper(coalesce(
  {', '.join(f"nullif(regexp_extract(upper({x}), '{p}', 1), '')" for p in replies.PHRASES)},
  case when length({x}) < 120 then nullif(regexp_extract({x}, '(?i)^([A-D])\\s*[.):\\-–]\\s*(?:$|\\S)', 1), '') end, nullif(regexp_extract({x}, '(?i)^\\(?([A-D])\\)?\\s*$', 1), ''))) end"""  # noqa: E731
_LOOSE = f"""said as (select *, [{_line_letter('x')} for x in l] as s from lined),
  loose as (select *, coalesce(list_filter(s[greatest(len(s) - 11, 1):], lambda x: x is not null)[-1], list_filter(s, lambda x: x is not null)[1]) as loose_letter from said)"""
_STRICT = r"""labelled as (select *, list_filter(l[1:12], lambda x: regexp_matches(x, '(?is)^(?:OPTION|ANSWER):')) as lab from loose)"""


@query(rf"""with {_LINES}, {_LOOSE}, {_STRICT},
  blocked as (select *, list_position([regexp_matches(x, '(?i)^REASON:') for x in l], true) as pos from labelled),
  rested as (select *, case when pos > 0 then l[pos:] else [] end as rest from blocked),
  kept as (select *, case when list_position([regexp_matches(x, '(?is)^(?:OPTION|ANSWER):') for x in rest], true) > 0
    then rest[1:list_position([regexp_matches(x, '(?is)^(?:OPTION|ANSWER):') for x in rest], true) - 1] else rest end as k from rested)
  select pred_id, coalesce(list_filter([regexp_extract(upper(x), '^(?:OPTION|ANSWER):\s*([A-D])\b', 1) for x in lab], lambda x: x <> '')[-1], loose_letter) as letter,
    coalesce(nullif({_strip("array_to_string([" + _strip("regexp_replace(x, '(?i)^REASON:', '')") + " for x in k], ' ')")}, ''),
      list_filter([{_strip("regexp_extract(x, '(?is)^[^:]*:.*?" + chr(92) + "b(?:BECAUSE|SINCE|AS)" + chr(92) + "b(.*)$', 1)")} for x in lab], lambda x: length(x) > 15)[-1], whole) as reason from kept""")
def reply_parse_strict(s, d):
    return _replied(s, d).select("pred_id", replies.strict(F.col("reply")).alias("p")).select("pred_id", "p.letter", "p.reason")


@query(rf"""with {_LINES}, {_LOOSE}, {_STRICT}
  select pred_id, list_filter([regexp_extract(upper(x), '\b([A-D])\b', 1) for x in lab], lambda x: x <> '')[-1] as letter,
    coalesce(nullif({_strip("regexp_replace(list_filter(l[1:12], lambda x: regexp_matches(x, '(?i)^REASON:'))[-1], '(?i)^REASON:', '')")}, ''), nullif(whole, ''), 'PARSE_FAILED: empty response') as reason from labelled""")
def reply_parse_simple(s, d):
    return _replied(s, d).select("pred_id", replies.simple(F.col("reply")).alias("p")).select("pred_id", "p.letter", "p.reason")


@query(f"with {_LINES}, {_LOOSE} select pred_id, loose_letter as letter from loose")
def reply_parse_loose(s, d):
    return _replied(s, d).select("pred_id", replies.loose_letter(F.col("reply")).alias("letter"))


@query(f"""with {_LINES} select pred_id, coalesce({', '.join(f"nullif(regexp_extract(upper(reply), '{p}', 1), '')" for p in replies.FORCING)},
  nullif(regexp_extract(upper(reply), '(?s)^(?:.*[^\\p{{L}}\\p{{N}}_])?([A-D])(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ''), 'ABCD'[('0x' || right(sha256(corpus), 1))::int % 4 + 1]) as letter from lined""")
def reply_parse_forced(s, d):
    return _replied(s, d).select("pred_id", replies.forced(F.col("reply"), F.col("corpus")).alias("letter"))


@query(r"""select pred_id, length(upper(reason)) - length(replace(upper(reason), 'OPTION:', '')) > 7 or regexp_matches(upper(reason), 'FORMAT FIX|YOU MUST|LINE 1:|LINE 2:|OUTPUT EXACTLY|CRITICAL:|\[FORCED_OPTION\]|OPTION: X') as is_echo,
  regexp_matches(reason, '^\s*[A-D]\.\s+.{12,}') as is_echoed_choice from predictions_option where reason is not null""")
def reply_echoes(s, d):
    rows = _option(s, d).where("reason is not null")
    return rows.select("pred_id", replies.is_echo(F.col("reason")).alias("is_echo"), replies.is_echoed_choice(F.col("reason")).alias("is_echoed_choice"))


@query("select pred_id, 'ABCD'[('0x' || right(sha256(reason), 1))::int % 4 + 1] as letter from predictions_option where reason is not null")
def forced_pick_by_hash(s, d):
    return _option(s, d).where("reason is not null").select("pred_id", text.hashed_letter(F.col("reason")).alias("letter"))


@query()
def clean_reasons(s, d):
    """Each reply's own reason, cleaned with the reply as its only source, as it is exported."""
    said = _replied(s, d)
    return said.select("pred_id", replies.exported_reason(replies.clean_reason(replies.strict(F.col("reply"))["reason"], F.array("reply"), F.lit(False))).alias("reason"))


@query()
def narrative_reasons(s, d):
    """The longest prose of all replies to a question in a run."""
    raws = _option(s, d).where("reason is not null").groupBy("run", "corpus", "question_number").agg(F.array_sort(F.collect_list("reason")).alias("raws"))
    return raws.select("run", "corpus", "question_number", replies.narrative(F.col("raws")).alias("reason"))


@query()
def first_phase_reasons(s, d):
    return _replied(s, d).select("pred_id", replies.first_phase(F.col("reply")).alias("reason"))


@query(r"""select pred_id, nullif(upper(regexp_extract(list_filter(regexp_split_to_array(reason, '\r?\n'), lambda x: regexp_matches(x, '\S'))[-1], '(?i)(?:^|[^A-Za-z0-9_])([ABCD])(?:[^A-Za-z0-9_]|$)', 1)), '') as letter from predictions_option""")
def final_line_letters(s, d):
    return _option(s, d).select("pred_id", text.final_line_letter(F.col("reason")).alias("letter"))


@query(r"""select event_id, try_cast(regexp_extract(props, '"k"\s*:\s*"?(-?\d+)', 1) as int) as k from events""")
def tolerant_json(s, d):
    wrapped = F.concat(F.lit("Sure: "), "props", F.lit(" end"))
    raw = table(s, d, "events").select("event_id", text.tolerant_json(wrapped).alias("v"))
    return raw.select("event_id", F.expr("try_variant_get(v, '$.k', 'int')").alias("k"))


@query("""select pred_id, greatest(0, least(3, coalesce(try_cast(option as int), length(reason) % 9 - 2, 0)))::int as score,
  case when length(reason) is null then 'parse_error' when length(reason) % 9 - 2 not between 0 and 3 then 'clamped' else '' end as note from predictions_option""")
def clamp(s, d):
    raw = (F.length("reason") % 9 - 2).cast("string")
    return _option(s, d).select("pred_id", text.clamped(raw, 0, 3).alias("score"), text.clamp_note(raw, 0, 3).alias("note"))


# --- readers and writers round trip -------------------------------------------------------------------------


def _as_file(s, d):
    """The questions rendered as block files, one a deck, as text frames: stems that go on in a second line, a stray line behind the first choice."""
    q = _questions(s, d).where("stem is not null and not stem rlike '[\\\\n\\\\r]'").where(F.forall(_values(), lambda v: ~v.rlike(r"[\n\r]")))
    written = q.select("deck", "question_number", F.explode(F.array("item_id")).alias("item_id")).join(sinks.rendered(q), "question_number")
    broken = F.regexp_replace(F.regexp_replace("block", r"\A(\d+\. \S+) ", "$1\n"), r"(\nA\. [^\n]*)", "$1\nstray line")
    written = written.withColumn("block", broken)
    return written.groupBy(F.coalesce("deck", F.lit("none")).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_number", "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def _read_sql(stem: str, stray: str, extra: str = "") -> str:
    sq = lambda x: rf"trim(regexp_replace({x}, '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
    return rf"""select question_number, {stem} as stem, n_choices, case when a is not null then a || '{stray}' end as first_choice from (
      select question_number, {sq('stem')} as st, len(map_keys(choices))::int as n_choices, {sq("choices['A']")} as a from questions_block
      where stem is not null and not regexp_matches(stem, '[\n\r]') and len(list_filter(map_values(choices), lambda v: regexp_matches(v, '[\n\r]'))) = 0) {extra}"""


_FIRST_WORD = "split_part(st, ' ', 1)"


def _read(s, d, dialect):
    got = blocks.items(_as_file(s, d), dialect)
    return got.select("question_number", text.squeeze(F.col("stem")).alias("stem"), F.size("choices").alias("n_choices"), text.squeeze(F.try_element_at("choices", F.lit("A"))).alias("first_choice"))


@query(_read_sql("st", ""))
def block_reader_stripping(s, d):
    return _read(s, d, "stripping")


@query(_read_sql(_FIRST_WORD, ""))
def block_reader_mapped(s, d):
    return _read(s, d, "mapped")


@query(_read_sql(_FIRST_WORD, "", "where n_choices = 4"))
def block_reader_strict(s, d):
    return _read(s, d, "strict")


@query(_read_sql("st", " stray line"))
def block_reader_lookahead(s, d):
    return _read(s, d, "lookahead")


@query(_read_sql("st", " stray line"))
def block_reader_lenient(s, d):
    return _read(s, d, "lenient")


def _key_lines(s, d):
    records = table(s, d, "raw_records").where("feed = 'answers'")
    return records.select(F.col("file_name").alias("path"), F.col("raw_id").alias("line_no"), F.col("raw_text").alias("line"))


def _key_sql(pattern: str, keep: str) -> str:
    return f"""with l as (select file_name as path, raw_id, trim(raw_text, E' \\t\\r\\n') as line from raw_records where feed = 'answers'),
      m as (select path, raw_id, try_cast(regexp_extract(line, '{pattern}', 1) as int) as n, upper(regexp_extract(line, '{pattern}', 2)) as letter
        from l where line <> '' and not starts_with(line, '#') and regexp_matches(line, '{pattern}'))
      select path, n as question_number, arg_max(letter, raw_id) as gold from m where {keep} group by path, n"""


@query(_key_sql(r"(?i)^(\d+)\s+([ABCD?])\s*$", "letter <> ''?''".replace("''", "'")))
def answer_key_letters(s, d):
    return keys.answer_key(_key_lines(s, d), "letters")


@query(_key_sql(r"(?i)^(\d+)[.)]?\s+([ABCD])\s*(?:#.*)?$", "true"))
def answer_key_marked(s, d):
    return keys.answer_key(_key_lines(s, d), "marked")


@query(_key_sql(r"(?i)^(\d+)[ \t]+([ABCD])\s*$", "true"))
def answer_key_blank(s, d):
    return keys.answer_key(_key_lines(s, d), "blank")


@query()
def html_items(s, d):
    """Items rendered as web pages, one a deck and number range, and read back."""
    q = _questions(s, d).where("stem is not null").join(_gold(s, d), ["corpus", "question_number"])
    li = F.array_join(F.transform(F.array_sort(F.map_keys("choices")), lambda k: F.concat(F.lit("<li>"), F.regexp_replace(F.col("choices")[k], "[<&>]", " "), F.lit("</li>"))), "")
    div = F.concat(F.lit('<div class="mcq" data-n="'), F.col("question_number").cast("string"), F.lit('"><p class="q">'), F.regexp_replace("stem", "[<&>]", " "), F.lit('</p><ol class="choices">'), li, F.lit('</ol><span class="key">'), "gold", F.lit("</span></div>"))
    pages = q.select(F.floor(F.col("question_number") / 50).alias("page_id"), "question_number", div.alias("div")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_number", "div"))), lambda x: x["div"]), "\n").alias("html"))
    return documents.html_items(pages)


@query()
def flashcards(s, d):
    """Explained items as flashcard dumps, read back by question-like lines."""
    e = table(s, d, "explained_items").where("question is not null and option_b is not null")
    card = e.select(F.col("pdf_name").alias("path"), "explained_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), text.squeeze(F.col("question")).alias("line")), F.struct(F.lit(1).alias("k"), text.squeeze(F.col("option_b")).alias("line")))).alias("x"))
    lines = card.select("path", (F.col("explained_id") * 2 + F.col("x.k") + 1).alias("line_no"), "x.line")
    heads = lines.select("path").distinct().select("path", F.lit(-1).cast("bigint").alias("line_no"), F.lit("Terms in this set (9)").alias("line"))
    return documents.flashcards_by_question(heads.unionByName(lines))


@query()
def transcript_items(s, d):
    q = _questions(s, d).where("stem is not null")
    spoken = F.concat(F.lit("00:00:01.000 question "), (F.col("question_number") % 10 + 1).cast("string"), F.lit(" "), F.lower("stem"), F.lit(" answer see explanation none"))
    return documents.transcript_items(q.select(F.col("item_id").cast("string").alias("path"), spoken.alias("text")))


# --- prompts, choices, text ---------------------------------------------------------------------------------


@query("""select question_number, list_transform([choices['A'], choices['B'], choices['C'], choices['D']], lambda x: x)[(question_number - 1) % 4 + 1 : 4] ||
  [choices['A'], choices['B'], choices['C'], choices['D']][1 : (question_number - 1) % 4] as rotated from questions_block""")
def choice_rotation(s, d):
    order = F.array(*[F.try_element_at("choices", F.lit(x)) for x in "ABCD"])
    return _questions(s, d).select("question_number", text.rotated(order, F.col("question_number")).alias("rotated"))


@query("""select question_number, array_to_string(list_filter([question_number || '. ' || coalesce(stem, ''), 'A. ' || choices['A'], 'B. ' || choices['B'], 'C. ' || choices['C'], 'D. ' || choices['D']], lambda x: x is not null), chr(10)) as prompt from questions_block""")
def prompt_build(s, d):
    q = modelcall.guarded(_questions(s, d).select("question_number", "stem", "choices"))
    return q.select("question_number", modelcall.question_prompt(F.col("question_number"), F.col("stem"), F.col("choices")).alias("prompt"))


@query(r"""with t as (select explained_id, list_filter(string_split(trim(regexp_replace(lower(option_b), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') as o,
  string_split(trim(regexp_replace(lower(explanation), '[^a-z0-9]+', ' ', 'g')), ' ') as h from explained_items)
  select explained_id, case when coalesce(len(o), 0) = 0 then 0.0::double else coalesce(len(list_filter(o, lambda x: list_contains(h, x))), 0)::double / len(o) end as overlap from t""")
def token_overlap(s, d):
    e = table(s, d, "explained_items")
    return e.select("explained_id", text.token_overlap(F.coalesce("option_b", F.lit("")), F.coalesce("explanation", F.lit(""))).alias("overlap"))


@query()
def difflib_best_match(s, d):
    """Every option of the explained items beside the bank of the held-out items' first choices."""
    bank = table(s, d, "public_items").select(F.conv(F.substring("id", 4, 7), 16, 10).cast("int").alias("pos"), F.get("choices", F.lit(0)).alias("term"), F.col("topic").alias("definition"))
    stems = table(s, d, "explained_items").where("option_b is not null").select(F.col("explained_id").alias("id"), F.col("option_b").alias("stem"))
    return similarity.best_terms(stems, bank)


@query()
def option_argmax(s, d):
    e = table(s, d, "explained_items")
    options = F.create_map(*[x for k in "abcd" for x in (F.lit(k.upper()), F.col(f"option_{k}"))])
    return e.select("explained_id", similarity.best_option(F.col("explanation"), options).alias("b")).select("explained_id", "b.letter", F.round("b.score", 6).alias("score"))


_FILLERS = r"regexp_replace({}, '(?i)(^|[^\p{L}\p{N}_])(?:(?:uh|um|er|hm)\s+)*(?:uh|um|er|hm)(?:\s+|$|([^\p{L}\p{N}_\s]))', '\1\2', 'g')"
_squeeze = lambda x: rf"trim(regexp_replace({x}, '{_BLANKS}+', ' ', 'g'))"
_PROSE = _squeeze(_FILLERS.replace("{}", _FILLERS.replace("{}", _squeeze("text"), 1), 1))
_PROSE = rf"regexp_replace(regexp_replace({_PROSE}, '\s+([.,;!?])', '\1', 'g'), ',\s*', ', ', 'g')"
_PROSE = f"replace(replace(replace(replace({_PROSE}, 'flashc cards', 'flash cards'), 'multiplechoice', 'multiple-choice'), 'coins insurance', 'coinsurance'), 'topics insurance regulation', 'topics, including insurance regulation')"


@query(f"select doc_id, {_PROSE} as prose from documents where text is not null")
def prose_clean(s, d):
    spoken = table(s, d, "documents").where(F.col("text").isNotNull())
    return spoken.select("doc_id", text.filler_free(F.col("text")).alias("prose"))


@query()
def prose_paragraphs(s, d):
    spoken = table(s, d, "documents").where("text is not null")
    return spoken.select("doc_id", parsing.prose_paragraphs(text.filler_free(F.col("text"))).alias("text"))


@query()
def prose_wrap(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(parsing.wrapped_text(F.col("text"))).alias("piece", "line"))


@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
  c as (select doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 16) / 112.0)::int)))::int as chunk_no from w)
  select doc_id, chunk_no, len(w[chunk_no * 112 + 1 : chunk_no * 112 + 128])::int as n_words, array_to_string(w[chunk_no * 112 + 1 : chunk_no * 112 + 3], ' ') as head from c""")
def chunk_overlap(s, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    parts = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(roadmap.chunks(words, 128, 16)).alias("c"))
    return parts.select("doc_id", "c.chunk_no", F.size("c.words").alias("n_words"), F.array_join(F.slice("c.words", 1, 3), " ").alias("head"))


@query("""with q as (select distinct unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) as g from (select regexp_extract_all(lower(question), '[a-z0-9]+') as w from public_items)),
  t as (select distinct doc_id, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) as g from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents))
  select doc_id, count(*) as n_shared from t join q using (g) group by doc_id""")
def contamination(s, d):
    return roadmap.contaminated(table(s, d, "documents"), table(s, d, "public_items"), "doc_id", "text")


@query("""with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0),
  p as (select query_id, vec_id, round(list_cosine_similarity(e::double[], embedding::double[]), 6) as score from q join embeddings on query_id <> vec_id)
  select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p) where rank <= 5""")
def topk_cosine(s, d):
    base = table(s, d, "embeddings")
    return roadmap.nearest(base.where("vec_id % 20 = 0"), base, 5)


@query(f"""with f as (select item_id, corpus, deck, stem, (coalesce(trim(deck), '') <> '')::int + (coalesce(trim(stem), '') <> '')::int as filled, length(coalesce(deck, '')) + length(coalesce(stem, '')) as len, {_SQ} as k from questions_block)
  select item_id from (select *, row_number() over (partition by k order by filled desc, len desc, item_id) as r from f) where r = 1 or k = ''""")
def richer_duplicates(s, d):
    q = _questions(s, d).select("item_id", "deck", "stem")
    return roadmap.richer(q, text.squash(F.coalesce("stem", F.lit(""))), ["deck", "stem"], "item_id").select("item_id")


@query("""select item_id, coalesce(length(stem), 0) >= 25 and len(map_values(choices)) = 4 and len(list_filter(map_values(choices), lambda v: length(v) < 8)) = 0 and len(list_distinct(map_values(choices))) = 4 as well_formed,
  len(list_filter(map_values(choices), lambda v: trim(v) <> '')) >= 2 as answerable from questions_block""")
def quality_gate(s, d):
    return _questions(s, d).select("item_id", balance.well_formed(F.col("stem"), F.col("choices")).alias("well_formed"), balance.answerable(F.col("choices")).alias("answerable"))


# --- joins and sets -----------------------------------------------------------------------------------------


@query(f"""with {_GOLD}, o as (select corpus, question_number, max(upper(trim(answer))) as gold from explained_items e join (select distinct corpus, question_number from questions_block) q using (question_number)
    where upper(trim(e.answer)) in ('A','B','C','D') group by all)
  select g.corpus, g.question_number, coalesce(o.gold, g.gold) as gold from gold g left join o using (corpus, question_number)""")
def override_merge(s, d):
    return _overridden_gold(s, d, table(s, d, "explained_items"))


def _overridden_gold(s, d, explained):
    e = explained.select("question_number", text.valid_letter(F.col("answer")).alias("gold")).where("gold is not null")
    fresh = e.join(_questions(s, d).select("corpus", "question_number"), "question_number").groupBy("corpus", "question_number").agg(F.max("gold").alias("gold"))
    return joins.overridden(_gold(s, d), fresh, ["corpus", "question_number"], "gold")


@query("select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey")
def strict_join(s, d):
    lookup = table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.strict(table(s, d, "orders").select("o_orderkey", "o_custkey"), lookup, ["o_custkey"], "c_name")


@query(f"""with {_TOPIC}, a as (select item_id, case when item_id % 5 = 0 then 9 else item_id % 8 + 1 end as bucket from questions_block where item_id % 4 <> 0)
  select t.item_id, case when a.bucket between 1 and 8 then a.bucket else t.bucket end::int as bucket from topic t left join a using (item_id)""")
def bucket_with_fallback(s, d):
    given = _questions(s, d).where("item_id % 4 <> 0").select("item_id", F.when(F.col("item_id") % 5 == 0, 9).otherwise(F.col("item_id") % 8 + 1).cast("int").alias("bucket"))
    base = _topic(s, d).withColumnRenamed("bucket", "computed")
    return joins.with_fallback(base, given, ["item_id"], "bucket", F.col("bucket").between(1, 8), F.col("computed")).select("item_id", "bucket")


@query("""with c as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'click'),
  v as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'view')
  select user_id, k::int as k, c.event_id as click_id, v.event_id as view_id from c join v using (user_id, k)""")
def ordinal_join(s, d):
    e = table(s, d, "events")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(f"{name}_ts"), F.col("event_id").alias(name))
    out = joins.by_ordinal(side("click", "click_id"), side("view", "view_id"), ["user_id"], ["click_id_ts", "click_id"], ["view_id_ts", "view_id"])
    return out.select("user_id", "k", "click_id", "view_id")


@query("""with spans as (select o_orderkey, o_custkey, o_orderdate as lo, o_orderdate + interval 3 day as hi from orders)
  select s.o_orderkey, count(*) as n from spans s join lineitem l on l.l_orderkey % 1500 = s.o_custkey % 1500 and l_shipdate >= lo and l_shipdate < hi group by s.o_orderkey""")
def interval_containment(s, d):
    spans = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 1500).alias("g"), F.col("o_orderdate").alias("lo"), F.expr("o_orderdate + interval 3 days").alias("hi"))
    points = table(s, d, "lineitem").select((F.col("l_orderkey") % 1500).alias("g"), "l_shipdate")
    return joins.within(points, spans, "l_shipdate", "lo", "hi", 3, ["g"]).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10)))))::int as line_no from documents where text is not null),
  b as (select *, sum((starts_with(line, '#') or starts_with(line, '=='))::int) over (partition by doc_id order by line_no)::bigint as block from l)
  select doc_id, block, count(*) as n_lines, min(line_no)::int as first_line from b group by all""")
def line_sessionise(s, d):
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = joins.sessions(lines, F.col("line").startswith("#") | F.col("line").startswith("=="), ["doc_id"], "line_no")
    return marked.groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10)))))::int as line_no from documents where text is not null)
  select doc_id, line_no, max(case when starts_with(line, 'Q') then line_no end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as before,
    min(case when starts_with(line, 'Q') then line_no end) over (partition by doc_id order by line_no rows between 1 following and unbounded following) as after from l""")
def nearest_marker(s, d):
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return joins.nearest_markers(lines, F.col("line").startswith("Q"), ["doc_id"], "line_no").select("doc_id", "line_no", "before", "after")


@query("""select 'both' as part, count(*) as n from (select distinct question_number from predictions_option intersect select distinct question_number from predictions_answer)
  union all select 'option_only', count(*) from (select distinct question_number from predictions_option except select distinct question_number from predictions_answer)
  union all select 'either', count(*) from (select question_number from predictions_option union select question_number from predictions_answer)""")
def set_operations(s, d):
    a, b = _option(s, d).select("question_number").distinct(), table(s, d, "predictions_answer").select("question_number").distinct()
    size = lambda name, frame: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return size("both", a.intersect(b)).union(size("option_only", a.subtract(b))).union(size("either", a.union(b).distinct()))


# --- model stages with stub clients -------------------------------------------------------------------------


@query("""select corpus, question_number, case when len(list_filter(map_values(choices), lambda v: trim(v) <> '')) >= 2 then 'ABCD'[(question_number - 1) % 4 + 1] else '' end as option from questions_block""")
def model_answers(s, d):
    items = _questions(s, d).select("corpus", "question_number", "stem", "choices")
    return modelcall.answered(items, modelcall.CyclingClient()).select("corpus", "question_number", "option")


@query("select corpus, question_number, 'B' as option, 'Think of the exclusions.' as reason_before_options from questions_block")
def model_two_phase(s, d):
    items = _questions(s, d).select("corpus", "question_number", "stem", "choices")
    out = modelcall.answered_in_two_phases(items, modelcall.ConstantClient("Think of the exclusions."), modelcall.ConstantClient("OPTION: B\nREASON: fits."))
    return out.select("corpus", "question_number", "option", "reason_before_options")


@query("select question_number, 8 as bucket, 'clamped' as notes from questions_block")
def model_classify(s, d):
    frame = _questions(s, d).select("question_number", modelcall.stem_prompt(F.col("question_number"), F.col("stem")).alias("prompt"))
    return modelcall.scored(frame, modelcall.JsonClient({"bucket": 12}), "bucket", 1, 8).select("question_number", "bucket", "notes")


@query()
def model_batches(s, d):
    items = _questions(s, d).select("corpus", "question_number", "stem")
    return modelcall.batched(items, modelcall.JsonClient({"ids": [1, 2]}), 7).select("corpus", "batch", "valid")


# --- streaming ----------------------------------------------------------------------------------------------


@query(f"""with {_GOLD}, p as (select corpus, run, question_number, option as l from predictions_option union all select corpus, run, question_number, answer from predictions_answer)
  select p.corpus, run, count(*) as compared, count(*) filter (upper(trim(l)) = gold) as correct
  from p join gold g on g.corpus = p.corpus and g.question_number = p.question_number where upper(trim(l)) in ('A','B','C','D') group by p.corpus, run""")
def stream_run_log(s, d):
    """The runs of both kinds as file streams, read to their end, in complete mode; what is kept is a row a run."""
    import uuid

    def live(name, letter):
        return run_log.stream(s, f"{d}/{name}.parquet*", table(s, d, name).schema).select("corpus", "run", "question_number", F.col(letter).alias("letter_given"))

    both = live("predictions_option", "option").unionByName(live("predictions_answer", "answer"))
    return run_log.drained(run_log.running_accuracy(both, cut(_gold(s, d)), "letter_given"), f"run_log_{uuid.uuid4().hex}")
