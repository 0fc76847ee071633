"""Queries of readers, writers' frames, page parsers and model stages over the driver's tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import parsing, rules, similarity, text
from tallyloom.operators import balance, cards, dedupe, modelcall
from tallyloom.plans.reference_queries import _BLANKS, _GOLD, _gold, _letters, _long, _option, _questions, _squeeze, query
from tallyloom.session import table
from tallyloom.sources import blocks, documents, keys, sinks

# --- readers ------------------------------------------------------------------------------------------------


@query(rf"""with l as (select pdf_name as path, explained_id as line_no, question_number || ' ' || {_squeeze('explanation')} as line from explained_items where explanation is not null),
  m as (select path, line_no, try_cast(regexp_extract(line, '^(\d+)\s+(.*)$', 1) as int) as n, trim(regexp_extract(line, '^(\d+)\s+(.*)$', 2)) as r from l where regexp_matches(line, '^\d+\s+.+$'))
  select path, n as question_number, arg_max(r, line_no) as reference from m where r <> '' and not starts_with(r, '#') group by path, n""")
def explanation_key(s, d):
    e = table(s, d, "explained_items").where("explanation is not null")
    line = F.concat_ws(" ", F.col("question_number").cast("string"), text.squeeze(F.col("explanation")))
    return keys.explanation_key(e.select(F.col("pdf_name").alias("path"), F.col("explained_id").alias("line_no"), line.alias("line")))


@query()
def prediction_reader(s, d):
    """The run files as whole CSV texts, read back as predictions."""
    lines = table(s, d, "run_file_lines").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return keys.predictions_of(lines.select(F.concat(F.col("file_id").cast("string"), F.lit(".csv")).alias("file"), "text"))


@query("""with f as (select question_number, case when question_number % 5 = 0 then 'x' else (question_number % 10)::varchar end as b, case when question_number % 3 = 0 then ' ' else 'own name' end as given from questions_block),
  r as (select question_number, try_cast(b as int) as bucket, given from f),
  dim as (select * from (values (1,'Basic concepts'),(2,'Contract law'),(3,'CA laws & ethics'),(4,'Tort & property fundamentals'),(5,'Residential property'),
    (6,'Valuation & government programs'),(7,'Personal liability & inland marine'),(8,'Commercial insurance')) t(bucket, bucket_name))
  select question_number, bucket, coalesce(nullif(trim(given), ''), bucket_name) as bucket_name from r join dim using (bucket)""")
def bucket_reader(s, d):
    n = F.col("question_number")
    frame = _questions(s, d).select(n.cast("string").alias("question_number"), F.when(n % 5 == 0, "x").otherwise((n % 10).cast("string")).alias("bucket"), F.when(n % 3 == 0, " ").otherwise("own name").alias("bucket_name"))
    return keys.bucket_assignment(frame)


@query("select id, source, topic, question, choices from public_items")
def public_item_reader(s, d):
    lines = table(s, d, "public_items").select(F.to_json(F.struct("id", "source", "topic", "question", "choices")).alias("value"))
    return keys.public_items_of(lines.union(lines.limit(1).select(F.lit(" "))))


@query("select id, correct_index from item_labels where correct_index is not null")
def label_reader(s, d):
    entries = table(s, d, "item_labels").select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("g"), F.struct("id", F.struct("correct_index").alias("label")).alias("e"))
    one = entries.groupBy("g").agg(F.to_json(F.struct(F.lit("v1").alias("schema"), F.map_from_entries(F.collect_list("e")).alias("labels"))).alias("value"))
    return keys.labels_of(one).where("correct_index is not null")


@query("""with s as (select case when file_id % 4 = 0 then ' ' else run end as run, count(*) as n from run_files group by 1) select run, n from s where trim(run) <> ''""")
def summary_reader(s, d):
    frame = table(s, d, "run_files").groupBy(F.when(F.col("file_id") % 4 == 0, " ").otherwise(F.col("run")).alias("run")).agg(F.count("*").alias("n"))
    return keys.judge_summary(frame)


@query("""with q as (select item_id, chr(65 + ((question_number - 1) % 4)::int) as letter, choices, list_transform(['A','B','C','D'], lambda x: trim(regexp_replace(lower(choices[x]), '\\s+', ' ', 'g'))) as v from questions_block where len(map_keys(choices)) = 4
    and len(list_filter(map_values(choices), lambda x: x is null or trim(x) = '')) = 0 and stem is not null)
  select item_id as page, chr(64 + list_position(v, trim(regexp_replace(lower(choices[letter]), '\\s+', ' ', 'g')))::int) as letter, 'green' as tier from q""")
def highlighted_answers(s, d):
    """Items drawn as pages: four tiles, a text on each, a green stroke around one; read back from the geometry."""
    q = _questions(s, d).where("stem is not null and size(map_keys(choices)) = 4").where(F.forall(F.map_values("choices"), lambda v: v.isNotNull() & (F.trim(v) != "")))
    number = F.col("question_number")
    box = lambda i, grow: [F.lit(50.0 - grow).alias("x0"), (F.lit(210.0) + 60 * i - grow).alias("y0"), F.lit(250.0 + grow).alias("x1"), (F.lit(250.0) + 60 * i + grow).alias("y1")]
    shape = lambda kind, fill, i, grow, said: F.struct(F.lit(kind).alias("kind"), F.array(*[F.lit(x) for x in fill]).alias("fill"), *box(i, grow), said.alias("text"))
    none = F.lit(None).cast("string")
    tiles = [shape("tile", (0.9, 0.9, 0.8), F.lit(i), 0.0, none) for i in range(4)]
    said = [shape("text", (0.0, 0.0, 0.0), F.lit(i), -12.0, F.col("choices")[x]) for i, x in enumerate("ABCD")]
    stroke = shape("stroke", (0.1, 0.6, 0.2), F.pmod(number - 1, F.lit(4)), 0.0, none)
    pages = q.select(F.col("item_id").alias("page"), F.explode(F.array(*tiles, *said, stroke)).alias("g")).select("page", "g.*")
    return documents.highlighted(pages, q.select(F.col("item_id").alias("page"), "stem", "choices")).select("page", "letter", "tier")


# --- what writers write ---------------------------------------------------------------------------------------


@query()
def block_writer(s, d):
    return blocks.rendered(_questions(s, d).where("stem is not null")).select("question_number", "block")


@query(f"""with {_GOLD}, r as (select run, corpus, question_number, arg_max(upper(trim(option)), row(answered_at, pred_id)) as option, arg_max(reason, row(answered_at, pred_id)) as reason from predictions_option where run = (select min(run) from predictions_option)
    group by all)
  select distinct q.question_number, coalesce(r.option, '') as option, coalesce(r.reason, 'No result.') as reason from (select distinct corpus, question_number from questions_block) q left join r using (corpus, question_number)""")
def prediction_writer(s, d):
    """The rows of the first run's file: every question, also those it did not answer."""
    p = _option(s, d)
    first = p.agg(F.min("run").alias("run"))
    said = p.join(F.broadcast(first), "run").groupBy("corpus", "question_number").agg(F.max_by(F.struct(F.upper(F.trim("option")).alias("option"), "reason"), F.struct("answered_at", "pred_id")).alias("x"))
    return sinks.prediction_rows(_questions(s, d), said.select("question_number", "x.option", "x.reason")).distinct()


@query("""select question_number, bucket, bucket_name, 'rules' as model, '' as notes from (select question_number, question_number % 8 + 1 as bucket from questions_block) join
  (select * from (values (1,'Basic concepts'),(2,'Contract law'),(3,'CA laws & ethics'),(4,'Tort & property fundamentals'),(5,'Residential property'),
    (6,'Valuation & government programs'),(7,'Personal liability & inland marine'),(8,'Commercial insurance')) t(bucket, bucket_name)) using (bucket)""")
def bucket_writer(s, d):
    assigned = _questions(s, d).select("question_number", (F.pmod("question_number", F.lit(8)) + 1).cast("int").alias("bucket"), F.lit(None).cast("string").alias("notes"))
    return sinks.bucket_rows(assigned, "rules")


@query(rf"""with {_GOLD} select question_number as question_num, '' as answer, left({_squeeze("coalesce(stem, '')")}, 120) as stem_preview from questions_block q
  where not exists (select 1 from gold g where g.question_number = q.question_number)""")
def key_template(s, d):
    return sinks.key_template(_questions(s, d), _gold(s, d))


@query("select source, count(*) as n_items, min(length(question))::int as first_number, max(length(question))::int as last_number from public_items group by source")
def source_manifest(s, d):
    return sinks.manifest(table(s, d, "public_items").select("source", F.length("question").alias("question_number")))


@query("select '| ' || corpus || ' | ' || replace(run, '|', '/') || ' | ' || n || ' |' as value from (select coalesce(corpus, '') as corpus, coalesce(run, '') as run, count(*) as n from predictions_option group by all)")
def run_log_lines(s, d):
    return sinks.log_line(_option(s, d).groupBy("corpus", "run").agg(F.count("*").alias("n")))


@query("select p.id, question, correct_index from public_items p join item_labels l using (id) where correct_index is not null")
def public_and_labels(s, d):
    """Items and labels written apart, joined again by id."""
    items, labels = sinks.public_and_labels(table(s, d, "public_items").join(table(s, d, "item_labels"), "id", "left"))
    return items.join(labels, "id").select("id", "question", "correct_index")


@query()
def match_score_rows(s, d):
    e = table(s, d, "explained_items").where("explanation is not null")
    options = F.create_map(*[x for k in "abcd" for x in (F.lit(k.upper()), F.col(f"option_{k}"))])
    best = e.select(F.col("explained_id").alias("n"), F.lit(1.0).alias("stem_match_score"), similarity.best_option(F.col("explanation"), options)["score"].alias("option_match_score"), F.lit("bank").alias("source"), F.col("explanation").alias("definition"))
    return sinks.match_scores(best)


@query()
def heatmap_frame(s, d):
    return sinks.heatmap_frame(_long(s, d))


# --- pages ----------------------------------------------------------------------------------------------------


def _page_lines(s, d):
    """Each explained item as a card of a study page: its lines in order, with the page's own lines between."""
    e = table(s, d, "explained_items").where("question is not null")
    line = lambda k, c: F.struct(F.lit(k).alias("k"), c.alias("line"))
    options = [line(i, F.concat(F.lit(f"{i}. "), text.squeeze(F.coalesce(f"option_{x}", F.lit("none of these at all"))))) for i, x in enumerate("abcd", 1)]
    parts = F.array(line(0, F.concat(F.lit("Which is so? "), text.squeeze(F.col("question")))), *options, line(5, text.squeeze(F.coalesce("option_b", F.lit("")))), line(6, F.lit("Not quite.")), line(7, F.lit("3 / 4")))
    return e.select(F.col("pdf_name").alias("path"), "explained_id", F.explode(parts).alias("x")).select("path", (F.col("explained_id") * 8 + F.col("x.k")).alias("line_no"), "x.line")


@query()
def numbered_cards(s, d):
    return cards.numbered_cards(_page_lines(s, d))


@query()
def flipped_cards(s, d):
    q = _questions(s, d).where("stem is not null and size(map_keys(choices)) = 4")
    term = F.col("item_id") % 2 == 0
    options = F.transform(F.array_sort(F.map_keys("choices")), lambda k: text.squeeze(F.col("choices")[k]))
    stem = F.array(text.squeeze(F.col("stem")))
    parts = F.concat(F.array(F.when(term, "Term").otherwise("Definition")), F.when(term, F.concat(stem, options)).otherwise(F.concat(options, stem)), F.array(F.lit("1 of 9")))
    lines = q.select(F.coalesce("deck", F.lit("none")).alias("path"), "item_id", F.posexplode(parts).alias("i", "line"))
    return cards.flipped_cards(lines.select("path", (F.col("item_id") * 8 + F.col("i")).alias("line_no"), "line"))


@query()
def interactive_items(s, d):
    """Each deck as an interactive test: stem, progress line, four options, don't-know line."""
    q = _questions(s, d).where("stem is not null and size(map_keys(choices)) = 4").select(F.coalesce("deck", F.lit("none")).alias("path"), "item_id", "stem", "choices")
    n = F.count("*").over(Window.partitionBy("path"))
    q = dedupe.numbered(q.withColumn("n", n), "item_id", ["path"])
    options = F.transform(F.array_sort(F.map_keys("choices")), lambda k: F.regexp_replace(text.squeeze(F.col("choices")[k]), "^[a-z]", "X"))
    parts = F.concat(F.array(F.concat(F.lit("Say "), text.squeeze(F.col("stem"))), F.concat_ws(" ", F.col("ordinal").cast("string"), F.lit("of"), F.col("n").cast("string"))), options, F.array(F.lit("Don't know?")))
    lines = q.select("path", "ordinal", F.posexplode(parts).alias("i", "line"))
    return cards.interactive_items(lines.select("path", (F.col("ordinal") * 10 + F.col("i")).alias("line_no"), "line"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null)
  select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(regexp_replace(lower(line), '[^a-z0-9]', '', 'g'), '(\d+of\d+$)|(^\d+of\d+)')) as n_progress,
    count(*) filter (contains(regexp_replace(lower(line), '[^a-z0-9]', '', 'g'), 'dontknow')) as n_dont_know from l group by doc_id""")
def page_markers(s, d):
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(rules.progress(F.col("line")).isNotNull()).alias("n_progress"), F.count_if(rules.dont_know(F.col("line"))).alias("n_dont_know"))


@query()
def question_starts(s, d):
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(rules.question_start(F.col("line"))).alias("n_starts"), F.count_if(rules.page_junk(F.col("line"))).alias("n_junk"), F.count_if(rules.feedback(F.col("line"))).alias("n_feedback"))


@query("select pdf_name, case when contains(replace(lower(pdf_name), ' ', ''), 'qaa') then 'numbered' else 'interactive' end as kind, regexp_replace(regexp_replace(pdf_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as safe from (select distinct pdf_name from explained_items)")
def page_kinds(s, d):
    names = table(s, d, "explained_items").select("pdf_name").distinct()
    return names.select("pdf_name", rules.page_kind(F.col("pdf_name")).alias("kind"), text.safe_name(F.col("pdf_name")).alias("safe"))


@query()
def spoken_options(s, d):
    """Format blocks read aloud: options behind lone letters, peeled off again."""
    b = table(s, d, "format_blocks").where("stem is not null")
    spoken = F.concat_ws(" ", text.squeeze(F.col("stem")), *[x for k in "abcd" for x in (F.when(F.col(k).isNotNull(), k.upper()), text.squeeze(F.col(k)))])
    return b.select("block_id", parsing.peeled(spoken).alias("choices"), rules.spoken_answer(F.concat(F.lit("answer see "), spoken)).alias("answer"))


@query()
def folded_options(s, d):
    b = table(s, d, "format_blocks")
    return b.select("block_id", parsing.folded(F.array_compact(F.array("a", "b", "c", "d"))).alias("options"))


@query(rf"""select explained_id, left(regexp_replace(regexp_replace(h, '^{_BLANKS}+', ''), '{_BLANKS}+$', ''), 140) as head from (
  select explained_id, case when instr(line, '.') > 4 then left(line, instr(line, '.') - 1) else line end as h from (select explained_id, regexp_split_to_array(explanation, '\r?\n')[1] as line from explained_items))""")
def head_sentences(s, d):
    return table(s, d, "explained_items").select("explained_id", text.head_sentence(F.col("explanation")).alias("head"))


@query("select item_id, case when n > 0 then printf('%.2f%%', 100.0 * k / n) end as share from (select item_id, len(map_keys(choices)) as n, len(list_filter(map_values(choices), lambda v: length(v) > 12)) as k from questions_block)")
def percent_shares(s, d):
    long = F.size(F.filter(F.map_values("choices"), lambda v: F.length(v) > 12))
    return _questions(s, d).select("item_id", text.percent(long / F.nullif(F.size("choices"), F.lit(0))).alias("share"))


@query()
def best_dump_lines(s, d):
    """Options without a good term beside the held-out questions as raw lines."""
    e = table(s, d, "explained_items").where("option_b is not null").select(F.col("explained_id").alias("id"), F.col("option_b").alias("stem"))
    lines = table(s, d, "public_items").select(F.conv(F.substring("id", 4, 7), 16, 10).cast("int").alias("pos"), F.get("choices", F.lit(1)).alias("line"))
    return similarity.best_lines(e, lines, e.limit(0).select("id", F.lit(0.0).alias("score")))


# --- gates and counts -------------------------------------------------------------------------------------------


@query("""with v as (select item_id, length(trim(coalesce(stem, ''), ' ')) as n, list_filter([trim(x, ' ') for x in map_values(choices)], lambda x: x is not null) as v from questions_block)
  select item_id, n >= 25 and len(v) = 4 and list_min([length(x) for x in v]) >= 8 and len(list_distinct(v)) = 4 as generated, n >= 10 and len(v) = 4 and list_min([length(x) for x in v]) >= 2 and len(list_distinct(v)) = 4 as cards,
    n >= 1 and len(v) = 4 and list_min([length(x) for x in v]) >= 3 as repaired, n >= 1 and len(v) = 4 and list_min([length(x) for x in v]) >= 1 and len(list_distinct(v)) = 4 as pages from v""")
def item_gates(s, d):
    return _questions(s, d).select("item_id", *[balance.passes(g, F.col("stem"), F.col("choices")).alias(g) for g in balance.GATES])


@query("""with g as (select item_id, regexp_replace(lower(coalesce(stem, '')), '[^a-z0-9]+', '', 'g') as k from questions_block), dropped as (select item_id from (select *, min(item_id) over (partition by k) as m from g) where k <> '' and item_id > m)
  select count(*) as parsed, count(x.item_id) as removed, count(*) - count(x.item_id) as kept from g left join dropped x on g.item_id = x.item_id""")
def review_counts(s, d):
    q = _questions(s, d)
    dropped = dedupe.flagged(q, text.squash(F.col("stem")), "item_id").where("is_duplicate")
    return balance.review_counts(q, dropped, "item_id")


@query(f"""with {_GOLD} select item_id, stem, trim(coalesce(choices['A'], '')) as "A", trim(coalesce(choices['B'], '')) as "B", trim(coalesce(choices['C'], '')) as "C", trim(coalesce(choices['D'], '')) as "D", gold as answer,
  'kept_from_q' || question_number as notes from questions_block join gold using (corpus, question_number)""")
def kept_items(s, d):
    q = _questions(s, d).join(_gold(s, d), ["corpus", "question_number"])
    return q.select("item_id", balance.as_item(F.col("stem"), F.col("choices"), F.col("gold"), F.col("question_number")).alias("x")).select("item_id", "x.*")


@query("select run, count(*) as n from predictions_option where run in (select min(run) from predictions_option union select max(run) from predictions_option) group by run")
def allowed_runs(s, d):
    p = _option(s, d)
    ends = p.agg(F.min("run"), F.max("run")).first()
    return blocks.allowed(p, "run", sorted(set(ends))).groupBy("run").agg(F.count("*").alias("n"))


# --- model stages with stub clients -------------------------------------------------------------------------------


@query("""select corpus, question_number, case when len(list_filter(map_values(choices), lambda v: trim(v) <> '')) >= 2 then 'ABCD'[(question_number - 1) % 4 + 1] else '' end as option from questions_block""")
def model_answers_once(s, d):
    items = _questions(s, d).select("corpus", "question_number", "stem", "choices")
    return modelcall.answered_once(items, modelcall.Yielding(modelcall.CyclingClient(), temperature=0.0)).select("corpus", "question_number", "option")


@query("select id, 1 as pred_index from public_items")
def model_public_choices(s, d):
    return modelcall.chosen_public(table(s, d, "public_items").select("id", "question", "choices"), modelcall.Budgeted(modelcall.ConstantClient("B."), "small", [("small", 64)]), "One letter.")


@query(f"with {_GOLD} select pred_id, 3 as alignment_score, 'fits' as notes from predictions_option p where exists (select 1 from questions_block q where q.corpus = p.corpus and q.question_number = p.question_number)")
def model_judge(s, d):
    q = _questions(s, d).dropDuplicates(["corpus", "question_number"]).select("corpus", "question_number", "stem", "choices")
    frame = _option(s, d).join(q, ["corpus", "question_number"]).select("pred_id", "question_number", "stem", "choices", "option", "reason", F.lit(None).cast("string").alias("reference"))
    return modelcall.judged(frame, modelcall.JsonClient({"alignment_score": 7, "notes": "fits"})).select("pred_id", "alignment_score", "notes")


@query("select item_id, coalesce(stem, '') as text from questions_block")
def model_rewrites(s, d):
    frame = _questions(s, d).select("item_id", F.coalesce("stem", F.lit("")).alias("text"))
    return modelcall.rewritten(frame, modelcall.ConstantClient("no block"))


@query("select path, chunk_no, 'Which form is meant here?' as stem, 'B' as answer from (select source as path, doc_id as chunk_no from documents where length(trim(coalesce(text, ''))) >= 80)")
def model_reconstructed(s, d):
    item = {"stem": "Which form  is meant here?", "A": "first", "B": "second", "C": "third", "D": "fourth", "answer": "b"}
    chunks = table(s, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("chunk_no"), "text")
    return modelcall.reconstructed(chunks, modelcall.JsonClient({"items": [item]})).select("path", "chunk_no", "stem", "answer")


@query("select topic, case when n >= 3 then [1, 2, 3] else range(1, n + 1)::int[] end as keep from (select topic, count(*) as n from public_items group by topic)")
def model_keeps(s, d):
    items = table(s, d, "public_items").select("topic", F.conv(F.substring("id", 4, 7), 16, 10).cast("int").alias("question_number"), F.col("question").alias("stem"))
    return modelcall.picked_indices(items, modelcall.JsonClient({"keep": [2, 2, 900, 3]}), "topic", 3)


@query("select corpus, run, count(*) as n_letters from (select distinct corpus, run, question_number from (select corpus, run, question_number, option as l from predictions_option union all select corpus, run, question_number, answer from predictions_answer) where upper(trim(l)) in ('A','B','C','D')) group by all")
def letters_by_run(s, d):
    return _letters(s, d).groupBy("corpus", "run").agg(F.count("*").alias("n_letters"))
