"""Model stages: prompts from public columns, an injectable client, parsing, retries, quotas.

A stage is a ``mapInPandas`` over the items: the client object travels to the executors and is called once a
row there. Calls are costly and may differ between runs, so callers write a stage's result before they
aggregate it. The stub clients are deterministic and need no network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import replies
from tallyloom.functions.text import clamp_note, clamped, first_letter, letter_index, rotated, squeeze, tolerant_json, valid_letter
from tallyloom.operators.balance import answerable, passes
from tallyloom.operators.dedupe import numbered
from tallyloom.session import cut

SKIPPED = "SKIPPED: fewer than two choices"
#: what a second call asks for
FIX = ["The last reply could not be read. Follow the format exactly.", "Write two lines and nothing else:", "OPTION: one letter, A, B, C or D", "REASON: two or three sentences"]


class Client(Protocol):
    def complete(self, prompt: str, attempt: int, **options: object) -> str: ...


class ConstantClient:
    """Always the same reply."""

    def __init__(self, reply: str):
        self.reply = reply

    def complete(self, prompt: str, attempt: int, **options: object) -> str:
        return self.reply


class CyclingClient:
    """The letter at (number - 1) mod 4 of the prompt's first number; unlabelled on the first attempt of every third."""

    def complete(self, prompt: str, attempt: int, **options: object) -> str:
        number = int(next(iter(re.findall(r"\d+", prompt)), 1))
        letter = "ABCD"[(number - 1) % 4]
        return "It depends." if number % 3 == 0 and attempt == 0 else f"OPTION: {letter}\nREASON: The wording of choice {letter} fits the stem."


class JsonClient:
    """A fixed JSON object inside prose, as models return it."""

    def __init__(self, value: dict):
        self.value = value

    def complete(self, prompt: str, attempt: int, **options: object) -> str:
        return f"Here it is: {json.dumps(self.value)} Done."


class Budgeted:
    """A client with a token budget by model name; an empty reply is asked for again with twice the budget, up to ``retries`` times."""

    def __init__(self, client: Client, model: str, budgets: list[tuple[str, int]], default: int = 512, retries: int = 2):
        self.client, self.retries = client, retries
        self.budget = next((n for name, n in budgets if name in model.lower()), default)

    def complete(self, prompt: str, attempt: int, **options: object) -> str:
        for turn in range(self.retries + 1):
            reply = self.client.complete(prompt, attempt, **{**options, "max_tokens": self.budget << turn})
            if reply and reply.strip():
                return reply
        return ""


class Yielding:
    """A client that leaves out an option once the model's error names it (a temperature, for one), and remembers that."""

    def __init__(self, client: Client, **options: object):
        self.client, self.options = client, options

    def complete(self, prompt: str, attempt: int, **options: object) -> str:
        while True:
            try:
                return self.client.complete(prompt, attempt, **self.options, **options)
            except Exception as error:
                refused = [o for o in self.options if o in str(error)]
                if not refused:
                    raise
                self.options = {k: v for k, v in self.options.items() if k not in refused}


def guarded(frame: DataFrame, secret: tuple[str, ...] = ("gold", "answer", "correct_index", "correct_answer")) -> DataFrame:
    """The frame itself; an error if it holds a column with answers, which no prompt may see."""
    if leaking := [c for c in frame.columns if c.lower() in secret]:
        raise ValueError(f"a prompt frame must not hold {leaking}")
    return frame


def choice_lines(choices: Column, order: Column | None = None, blank: bool = False) -> Column:
    """``A. `` to ``D. `` lines of the choices that are there, or (``blank``) of all four."""
    letters = F.array(*[F.lit(x) for x in "ABCD"]) if order is None else order
    text = lambda x: F.coalesce(F.try_element_at(choices, x), F.lit(""))
    kept = letters if blank else F.filter(letters, lambda x: text(x) != "")
    return F.transform(kept, lambda x: F.concat(x, F.lit(". "), text(x)))


def question_prompt(number: Column, stem: Column, choices: Column, rotate: bool = False) -> Column:
    """``N. stem`` and the lettered choices in their order, or rotated by the number."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    order = rotated(letters, number) if rotate else letters
    return F.concat_ws("\n", F.concat(number.cast("string"), F.lit(". "), F.coalesce(stem, F.lit(""))), choice_lines(choices, order))


def instructed_prompt(instructions: list[str], number: Column, stem: Column, choices: Column, rotate: bool = False) -> Column:
    """Instructions, a blank line, ``Question N: stem`` and the choices."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    head = F.concat(F.lit("Question "), number.cast("string"), F.lit(": "), F.coalesce(stem, F.lit("")))
    return F.concat_ws("\n", *[F.lit(x) for x in instructions], F.lit(""), head, choice_lines(choices, rotated(letters, number) if rotate else letters))


def fix_prompt(instructions: list[str], number: Column, stem: Column, choices: Column, prior: Column, most: int = 1500) -> Column:
    """The instructed prompt once more, with the reply that could not be read."""
    context = F.when(F.trim(prior) != "", F.concat(F.lit("\n\nYour previous response (for context):\n"), F.left(F.trim(prior), F.lit(most)))).otherwise("")
    return F.concat(instructed_prompt(instructions, number, stem, choices, rotate=True), context)


def public_prompt(question: Column, choices: Column, instruction: str) -> Column:
    """A held-out item with its array of choices, and what to answer."""
    lettered = F.transform(choices, lambda x, i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(". "), x))
    return F.concat_ws("\n", F.trim(question), F.lit(""), lettered, F.lit(""), F.lit(instruction))


def stem_prompt(number: Column, stem: Column) -> Column:
    """The stem alone, for a first phase that must not see the choices."""
    return F.concat(number.cast("string"), F.lit(". "), F.coalesce(stem, F.lit("")), F.lit("\nReason about it; the choices follow later."))


def second_phase_prompt(number: Column, stem: Column, choices: Column, thought: Column) -> Column:
    """What was thought before the options, then the whole question."""
    head = F.concat(F.lit("Question "), number.cast("string"), F.lit(" (full, with options):"))
    return F.concat_ws("\n", F.lit("Your earlier reasoning (written before you saw any options):"), F.lit(""), F.trim(thought), F.lit(""), F.lit("---"), F.lit(""), head, F.coalesce(stem, F.lit("")), F.lit(""), choice_lines(choices))


def bucket_prompt(number: Column, stem: Column, choices: Column) -> Column:
    head = F.concat(F.lit("Question "), number.cast("string"), F.lit(":"))
    return F.concat_ws("\n", head, F.lit(""), F.coalesce(stem, F.lit("")), F.lit(""), F.lit("Options:"), choice_lines(choices))


def judge_prompt(number: Column, stem: Column, choices: Column, option: Column, reason: Column, reference: Column | None = None) -> Column:
    """Question, options, what the model chose and why, and the reference explanation where there is one."""
    filled = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(blank)"))
    parts = [
        F.lit("### Question"), F.concat(number.cast("string"), F.lit(". "), F.coalesce(stem, F.lit(""))), F.lit(""), F.lit("### Options"), choice_lines(choices, blank=True), F.lit(""),
        F.lit("### Model output"), F.concat(F.lit("Chosen option: "), filled(option)), F.lit("Explanation:"), filled(reason),
    ]
    body = F.concat_ws("\n", *parts)
    return body if reference is None else F.concat(body, F.coalesce(F.concat(F.lit("\n\n### Ground-truth explanation\n"), F.trim(reference)), F.lit("")))


def review_line(number: Column, stem: Column, choices: Column) -> Column:
    """``ID n | stem | A:... | B:...``: a squeezed stem of at most 280 characters and options of at most 120."""
    options = F.transform(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: F.concat(x, F.lit(":"), F.left(F.coalesce(F.try_element_at(choices, x), F.lit("")), F.lit(120))))
    return F.concat_ws(" | ", F.concat(F.lit("ID "), number.cast("string")), F.left(squeeze(F.coalesce(stem, F.lit(""))), F.lit(280)), options)


def completed(frame: DataFrame, client: Client, retries: int = 1, accept=None, partitions: int | None = None, attempt: int = 0) -> DataFrame:
    """The frame (with ``prompt``) with reply, attempts and error.

    A reply that ``accept`` refuses is asked for again, up to ``retries`` times. A client's exception ends no
    task: the reply is null and ``error`` holds its first 200 characters.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                reply, turn, error = None, attempt, None
                while True:
                    try:
                        reply, error = client.complete(prompt, turn), None
                    except Exception as failure:
                        error = f"{type(failure).__name__}: {failure}"[:200]
                    turn += 1
                    if turn - attempt > retries or (error is None and (accept is None or accept(reply))):
                        break
                rows.append((reply, turn - attempt, error))
            yield batch.assign(reply=[r for r, _, _ in rows], attempts=[n for _, n, _ in rows], error=[e for _, _, e in rows])

    schema = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes) + ", reply string, attempts int, error string"
    return (frame.repartition(partitions) if partitions else frame).mapInPandas(call, schema)


def answered(items: DataFrame, client: Client, force: bool = True, rotate: bool = False) -> DataFrame:
    """corpus, question_number, option, reason: every item answered; unanswerable ones blank with a note.

    Replies are read in the JVM: strictly, after a second call that shows the first reply where no letter was
    found, loosely over both replies, and at last (``force``) by a letter that the text or the stem's hash gives.
    """
    can = F.coalesce(answerable(F.col("choices")), F.lit(False))
    keys = ["corpus", "question_number", "stem", "choices"]
    asked = guarded(items).where(can).select(*keys, question_prompt(F.col("question_number"), F.col("stem"), F.col("choices"), rotate).alias("prompt"))
    first = cut(completed(asked, client, retries=0).withColumn("p", replies.strict(F.coalesce("reply", F.lit("")))))
    done = first.where("p.letter is not null").select(*keys, "p", F.array("reply").alias("raws"))
    number = F.col("question_number")
    again = first.where("p.letter is null").select(*keys, F.col("reply").alias("before"), fix_prompt(FIX, number, F.col("stem"), F.col("choices"), F.coalesce("reply", F.lit(""))).alias("prompt"))
    second = completed(again, client, retries=0, attempt=1).select(*keys, replies.strict(F.coalesce("reply", F.lit(""))).alias("p"), F.array_compact(F.array("before", "reply")).alias("raws"))
    both = done.unionByName(second).withColumn("merged", F.array_join("raws", "\n")).withColumn("letter", F.coalesce("p.letter", replies.loose_letter(F.col("merged"))))
    letter = F.coalesce("letter", replies.forced(F.col("merged"), F.col("stem")) if force else F.lit(""))
    reason = replies.exported_reason(replies.clean_reason(F.col("p.reason"), F.col("raws"), F.col("letter").isNull()))
    out = both.select("corpus", "question_number", letter.alias("option"), reason.alias("reason"))
    return out.unionByName(items.where(~can).select("corpus", "question_number", F.lit("").alias("option"), F.lit(SKIPPED).alias("reason")))


def answered_once(items: DataFrame, client: Client) -> DataFrame:
    """corpus, question_number, option, reason by the simple parser: one retry where no letter was found, then a blank option."""
    can = F.coalesce(answerable(F.col("choices")), F.lit(False))
    asked = guarded(items).where(can).select("corpus", "question_number", question_prompt(F.col("question_number"), F.col("stem"), F.col("choices")).alias("prompt"))
    first = cut(completed(asked, client, retries=0).withColumn("p", replies.simple(F.coalesce("reply", F.lit("")))))
    again = completed(first.where("p.letter is null").select("corpus", "question_number", "prompt"), client, retries=0, attempt=1).withColumn("p", replies.simple(F.coalesce("reply", F.lit(""))))
    shown = lambda f: f.select("corpus", "question_number", F.coalesce("p.letter", F.lit("")).alias("option"), F.col("p.reason").alias("reason"))
    skipped = items.where(~can).select("corpus", "question_number", F.lit("").alias("option"), F.lit(SKIPPED).alias("reason"))
    return shown(first.where("p.letter is not null")).unionByName(shown(again)).unionByName(skipped)


def chosen_public(items: DataFrame, client: Client, instruction: str) -> DataFrame:
    """id, pred_index of held-out items: the first standalone letter of the reply, null where there is none."""
    asked = guarded(items).select("id", public_prompt(F.col("question"), F.col("choices"), instruction).alias("prompt"))
    return completed(asked, client, retries=0).select("id", letter_index(first_letter(F.col("reply"))).alias("pred_index"))


def answered_in_two_phases(items: DataFrame, thinker: Client, chooser: Client, most: int = 4000, brief: int = 800) -> DataFrame:
    """corpus, question_number, reason_before_options, option, reason_after_options; the first phase sees no choices."""
    first = completed(guarded(items).select("corpus", "question_number", stem_prompt(F.col("question_number"), F.col("stem")).alias("prompt")), thinker)
    thought = cut(first.select("corpus", "question_number", F.left(replies.first_phase(F.coalesce("reply", F.lit(""))), F.lit(most)).alias("thought")))
    full = items.join(thought, ["corpus", "question_number"]).select(
        "corpus", "question_number", "thought", second_phase_prompt(F.col("question_number"), F.col("stem"), F.col("choices"), F.col("thought")).alias("prompt")
    )
    parsed = completed(full, chooser).withColumn("p", replies.strict(F.coalesce("reply", F.lit(""))))
    return parsed.select(
        "corpus", "question_number", F.left("thought", F.lit(brief)).alias("reason_before_options"), F.coalesce("p.letter", F.lit("")).alias("option"), F.col("p.reason").alias("reason_after_options")
    )


def scored(frame: DataFrame, client: Client, field: str, low: int, high: int, notes: str | None = None) -> DataFrame:
    """The frame with a whole number from the reply's JSON, clamped, and a note.

    The note is the reply's own field ``notes``, where one is named, else what was wrong with the number; after
    a client's error the number is ``low`` and the note its first 200 characters.
    """
    raw = F.expr(f"try_variant_get(parsed, '$.{field}', 'string')")
    replied = completed(frame, client).withColumn("parsed", tolerant_json(F.col("reply")))
    # A JSON number with a fraction is cut to its whole part; a string that holds one is no whole number.
    fraction = F.expr(f"schema_of_variant(try_variant_get(parsed, '$.{field}', 'variant'))").rlike("^(?:DOUBLE|FLOAT|DECIMAL)")
    whole = F.when(fraction, F.regexp_extract(raw, r"^(-?\d+)", 1)).otherwise(raw)
    note = clamp_note(F.col("_raw"), low, high) if notes is None else F.coalesce(F.expr(f"try_variant_get(parsed, '$.{notes}', 'string')"), clamp_note(F.col("_raw"), low, high))
    return (
        replied.withColumn("_raw", whole).withColumn(field, clamped(F.col("_raw"), low, high))
        .withColumn("notes", F.coalesce(F.col("error"), note)).drop("_raw", "parsed", "attempts", "error")
    )


def judged(frame: DataFrame, client: Client) -> DataFrame:
    """The frame (question_number, stem, choices, option, reason, reference) with alignment_score 0 to 3 and the judge's notes."""
    prompt = judge_prompt(*[F.col(c) for c in ("question_number", "stem", "choices", "option", "reason", "reference")])
    return scored(frame.withColumn("prompt", prompt), client, "alignment_score", 0, 3, notes="notes").drop("prompt", "reply")


def reviewed(items: DataFrame, client: Client, most: int = 5_000) -> DataFrame:
    """members: the groups of duplicates a model names for a whole list in one call; the list's length is checked."""
    if items.limit(most + 1).count() > most:
        raise ValueError(f"one review call takes at most {most} items")
    lines = items.select("question_number", review_line(F.col("question_number"), F.col("stem"), F.col("choices")).alias("line"))
    prompt = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_number", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
    groups = F.from_json(F.regexp_extract("reply", r"\{[\s\S]*\}", 0), "duplicate_groups array<array<int>>")
    return completed(prompt, client).select(F.explode(groups["duplicate_groups"]).alias("members")).where(F.size("members") > 1)


def batched(frame: DataFrame, client: Client, size: int, tries: int = 3) -> DataFrame:
    """corpus, batch, expected, got, valid, repeats, tries, reply: one call for each slice of ``size`` numbers.

    A reply is valid if its items name the same ids, each once, and no item repeats an option; an invalid one is
    asked for again, up to ``tries`` times, and only the slices that are still invalid go on.
    """
    grouped = numbered(frame, "question_number", ["corpus"]).withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("bigint")).groupBy("corpus", "batch").agg(
        F.array_sort(F.collect_list("question_number")).alias("expected"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_number", F.coalesce("stem", F.lit("")).alias("stem")))), lambda x: F.concat(x["question_number"].cast("string"), F.lit(". "), x["stem"])), "\n").alias("prompt"),
    )
    items = F.from_json(F.regexp_extract("reply", r"\{[\s\S]*\}", 0), "items array<struct<id int, A string, B string, C string, D string>>")["items"]
    options = lambda x: F.array_compact(F.array(x["A"], x["B"], x["C"], x["D"]))
    repeats = F.transform(F.filter(F.coalesce("items", F.array().cast("array<struct<id int, A string, B string, C string, D string>>")), lambda x: F.size(F.array_distinct(options(x))) < F.size(options(x))), lambda x: x["id"])
    done, todo = None, grouped.withColumn("tries", F.lit(0))
    for turn in range(tries):
        called = completed(todo.select("corpus", "batch", "expected", "prompt"), client, retries=0, attempt=turn).withColumn("items", items)
        checked = called.withColumn("repeats", repeats).withColumn("got", F.array_sort(F.coalesce(F.transform("items", lambda x: x["id"]), F.array().cast("array<int>"))))
        checked = cut(checked.withColumn("valid", F.col("got").eqNullSafe(F.col("expected")) & (F.size("repeats") == 0)).withColumn("tries", F.lit(turn + 1)))
        settled = checked if turn == tries - 1 else checked.where("valid")
        done = settled if done is None else done.unionByName(settled)
        todo = checked.where("not valid")
        if turn < tries - 1 and todo.isEmpty():
            break
    return done.select("corpus", "batch", "expected", "got", "valid", "repeats", "tries", "reply")


def reconstructed(chunks: DataFrame, client: Client, least: int = 80, most: int | None = None) -> DataFrame:
    """path, chunk_no, stem, choices, answer: the items that a model finds in noisy chunks of ``least`` characters or more, those with four distinct options."""
    asked = chunks.where(F.length(F.trim("text")) >= least)
    if most is not None:
        asked = asked.where(F.col("chunk_no") < most)
    item = "items array<struct<stem string, A string, B string, C string, D string, answer string>>"
    replied = completed(asked.select("path", "chunk_no", F.col("text").alias("prompt")), client)
    rows = replied.select("path", "chunk_no", F.explode(F.from_json(F.regexp_extract("reply", r"\{[\s\S]*\}", 0), item)["items"]).alias("x"))
    choices = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABCD"]), F.array(*[squeeze(F.col(f"x.{x}")) for x in "ABCD"]))
    good = rows.select("path", "chunk_no", squeeze(F.col("x.stem")).alias("stem"), choices.alias("choices"), F.coalesce(valid_letter(F.col("x.answer")), F.lit("?")).alias("answer"))
    return good.where(passes("pages", F.col("stem"), F.col("choices")))


def picked_indices(items: DataFrame, client: Client, by: str, n: int, most: int = 5_000) -> DataFrame:
    """by, keep: the n places a model keeps of each group, in one call a group; repeats and places out of range go, the least missing ones fill up.

    A group is one prompt, so its size is checked against ``most``.
    """
    sizes = items.groupBy(by).agg(F.count("*").alias("n"))
    if sizes.where(F.col("n") > most).limit(1).count():
        raise ValueError(f"one call takes at most {most} items")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("question_number", F.coalesce("stem", F.lit("")).alias("stem")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.left(x["stem"], F.lit(280))))
    grouped = items.groupBy(by).agg(F.array_join(lines, "\n").alias("prompt"), F.count("*").cast("int").alias("n_items"))
    keep = F.coalesce(F.from_json(F.regexp_extract("reply", r"\{[\s\S]*\}", 0), "keep array<int>")["keep"], F.array().cast("array<int>"))
    valid = F.filter(F.array_distinct(keep), lambda x: x.between(1, F.col("n_items")))
    missing = F.array_except(F.sequence(F.lit(1), F.col("n_items")), valid)
    return completed(grouped, client).select(by, F.array_sort(F.slice(F.concat(valid, missing), 1, n)).alias("keep"))


def rewritten(frame: DataFrame, client: Client) -> DataFrame:
    """The frame with ``text`` replaced by the reply's block, or kept where the reply holds none."""
    block = F.nullif(F.trim(F.regexp_extract("reply", r"(?s)(\d+\.\s.*)", 1)), F.lit(""))
    return completed(frame.withColumn("prompt", F.col("text")), client).withColumn("text", F.coalesce(block, F.col("text"))).drop("prompt", "reply", "attempts", "error")


def until_quota(ask, accepted: DataFrame, quota: int, stem: str, order: str, most_rounds: int = 15) -> DataFrame:
    """Accepted rows once a round's ``ask(round, accepted)`` has filled the quota; ends after a round without progress.

    The accepted set is written (checkpointed) every round; only its count reaches the driver.
    """
    from tallyloom.operators.dedupe import against_accepted

    have = accepted.count()
    for turn in range(most_rounds):
        if have >= quota:
            break
        fresh = against_accepted(ask(turn, accepted), accepted, stem, order)
        accepted = cut(accepted.unionByName(fresh.orderBy(order).limit(quota - have)))
        now = accepted.count()
        if now == have:
            break
        have = now
    return accepted
