"""Flashcard dumps, transcripts, web pages, page text and page geometry as sources of items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.rules import spoken_answer, spoken_number
from tallyloom.functions.similarity import ratio
from tallyloom.functions.text import is_green, luminance, squeeze, strip

QUESTION_LIKE = r"(?i)^(?:which|what|who|when|where|why|how|under|if|an?|all|each)\b.*[?:]$|^.{36,}\?|^\d.*\?"


def _dump_lines(lines: DataFrame) -> DataFrame:
    """The lines of a dump between its opening and its closing mark, without images, links and blanks."""
    order = Window.partitionBy("path").orderBy("line_no")
    text = lines.select("path", "line_no", strip(F.col("line")).alias("line"))
    text = text.withColumn("begun", F.coalesce(F.max(F.col("line").contains("Terms in this set (")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    text = text.withColumn("ended", F.max(F.col("line").startswith("See more")).over(order))
    return text.where("begun and not ended and line <> ''").where(~F.col("line").rlike(r"^!\[|^\[.*\]\(|^https?://"))


def flashcards_alternating(lines: DataFrame) -> DataFrame:
    """path, pos, term, definition: terms and definitions in turn; a definition that follows EXCEPT goes on with the term."""
    order = Window.partitionBy("path").orderBy("line_no")
    text = _dump_lines(lines).withColumn("goes_on", F.coalesce(F.lag("line").over(order).rlike(r"EXCEPT:?$"), F.lit(False)))
    text = text.withColumn("n", F.sum((~F.col("goes_on")).cast("int")).over(order) - 1)
    cards = text.groupBy("path", F.floor(F.col("n") / 2).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("line_no", "n", "line"))).alias("l"))
    side = lambda k: F.array_join(F.transform(F.filter("l", lambda x: F.pmod(x["n"], F.lit(2)) == k), lambda x: x["line"]), " ")
    return cards.select("path", "pos", side(0).alias("term"), side(1).alias("definition")).where("definition <> ''")


def flashcards_by_question(lines: DataFrame, least_term: int = 12, least_definition: int = 3) -> DataFrame:
    """path, pos, term, definition: chunks start at question-like lines, their last line is the definition."""
    order = Window.partitionBy("path").orderBy("line_no")
    text = _dump_lines(lines).where(~F.col("line").rlike(r"^[a-d]\)\s"))
    text = text.withColumn("pos", F.sum(F.col("line").rlike(QUESTION_LIKE).cast("int")).over(order) - 1).where("pos >= 0")
    chunks = text.groupBy("path", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("l"))
    cards = chunks.where(F.size("l") > 1).select("path", "pos", F.array_join(F.slice("l", F.lit(1), F.size("l") - 1), " ").alias("term"), F.element_at("l", -1).alias("definition"))
    return cards.where((F.length("term") >= least_term) & (F.length("definition") >= least_definition))


def transcript_items(texts: DataFrame) -> DataFrame:
    """path, ordinal, question_number, body, answer: spoken items between "question <number>" marks, stamps taken out."""
    plain = squeeze(F.regexp_replace("text", r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?", " "))
    parts = texts.select("path", F.posexplode(F.split(plain, r"(?i)\bquestion (?=(?:one|two|three|four|five|six|seven|eight|nine|ten|n|\d+)\b)")).alias("ordinal", "part")).where("ordinal > 0")
    word = F.regexp_extract("part", r"^(\w+)", 1)
    return parts.select("path", "ordinal", spoken_number(word).alias("question_number"), strip(F.regexp_replace("part", r"^\w+\W*", "")).alias("body"), spoken_answer(F.col("part")).alias("answer"))


class _Mcq(HTMLParser):
    """Collects ``div.mcq`` with its ``p.q`` or ``.question``, ``ol.choices li`` and ``.key`` or ``.answer``."""

    def __init__(self):
        super().__init__()
        self.items, self.item, self.depth, self.into = [], None, 0, None

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        classes = (names.get("class") or "").split()
        if tag == "div" and "mcq" in classes and self.item is None:
            self.item, self.depth = {"n": names.get("data-n"), "stem": "", "choices": [], "key": ""}, 0
        if self.item is None:
            return
        self.depth += tag == "div"
        if "q" in classes and tag == "p" or "question" in classes:
            self.into = "stem"
        elif tag == "li":
            self.item["choices"].append("")
            self.into = "choices"
        elif "key" in classes or "answer" in classes:
            self.into = "key"

    def handle_endtag(self, tag):
        if self.item is None:
            return
        if tag in ("p", "li", "span"):
            self.into = None
        if tag == "div":
            self.into = None
            self.depth -= 1
            if self.depth == 0:
                self.items.append(self.item)
                self.item = None

    def handle_data(self, data):
        if self.item is None or self.into is None:
            return
        if self.into == "choices":
            self.item["choices"][-1] += data
        else:
            self.item[self.into] += data


def html_items(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, question_number, stem, choices, gold of pages (page_id, html); four choices and a key are needed."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Mcq()
                parser.feed(html or "")
                for i, item in enumerate(parser.items):
                    key = item["key"].strip()[:1].upper()
                    choices = [" ".join(c.split()) for c in item["choices"]]
                    if key in "ABCD" and key and len(choices) == 4:
                        number = int(item["n"]) if (item["n"] or "").isdigit() else i + 1
                        rows.append((page, i, number, " ".join(item["stem"].split()), dict(zip("ABCD", choices, strict=True)), key))
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "question_number", "stem", "choices", "gold"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(scan, f"page_id {kind}, ordinal int, question_number int, stem string, choices map<string,string>, gold string")


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page, text of binary files (path, content), where a PDF library is installed on the executors."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as error:
            raise RuntimeError("reading PDF files needs pypdf on the executors") from error
        for batch in batches:
            rows = [(p, i, page.extract_text() or "") for p, c in zip(batch["path"], batch["content"], strict=True) for i, page in enumerate(PdfReader(io.BytesIO(c)).pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(scan, "path string, page int, text string")


def page_sample(pages: DataFrame, head: int = 55, middle: int = 45, tail: int = 45, least: int = 40, budget: int = 110_000) -> DataFrame:
    """path, page, text: pages of the head, from a third on, and of the tail, short pages left out, up to a budget of characters."""
    order = Window.partitionBy("path")
    n = F.max("page").over(order) + 1
    third = F.floor(n / 3)
    chosen = pages.withColumn("n", n).where((F.col("page") < head) | F.col("page").between(third, third + middle - 1) | (F.col("page") >= F.col("n") - tail)).where(F.length("text") >= least)
    used = F.sum(F.length("text")).over(order.orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return chosen.withColumn("used", used).where(F.col("used") <= budget).select("path", "page", "text")


def _cells(spans: DataFrame, boxes: DataFrame, grow: float = 3.0) -> DataFrame:
    """boxes with ``text``: the texts of the spans that meet the box, grown by ``grow`` on each side, in reading order."""
    meets = (F.col("a0") < F.col("x1") + grow) & (F.col("a1") > F.col("x0") - grow) & (F.col("b0") < F.col("y1") + grow) & (F.col("b1") > F.col("y0") - grow)
    parts = boxes.join(spans, "page").where(meets).groupBy("page", "box").agg(F.array_sort(F.collect_list(F.struct("b0", "a0", "said"))).alias("parts"))
    return boxes.join(parts, ["page", "box"]).withColumn("text", squeeze(F.lower(F.array_join(F.transform("parts", lambda x: x["said"]), " ")))).drop("parts")


@F.pandas_udf(T.StructType([T.StructField("letter", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("stem_score", T.DoubleType())]))
def _option_of(text: pd.Series, stem: pd.Series, choices: pd.Series) -> pd.DataFrame:
    """The option most like a cell's text, and how like the stem the text is."""

    def like(said: str, option: str) -> float:
        score = ratio(said, option)
        if len(option) > 10 and (said.startswith(option) or option.startswith(said)):
            return max(score, 0.92)
        if len(said) > 10 and said in option or len(option) > 10 and option in said:
            return max(score, 0.88)
        return score

    rows = []
    for said, question, options in zip(text, stem, choices, strict=True):
        shown = {k: " ".join(v.lower().split()) for k, v in sorted(dict(options or {}).items()) if v and v.strip()}
        scores = [(1.0 if said == o else like(said, o), k) for k, o in shown.items()] if said else []
        score, letter = max(scores, key=lambda x: x[0]) if scores else (0.0, None)
        rows.append((letter, score, ratio(said or "", " ".join((question or "").lower().split()))))
    return pd.DataFrame(rows, columns=["letter", "score", "stem_score"])


def highlighted(geometry: DataFrame, items: DataFrame) -> DataFrame:
    """page, letter, score, tier of pages' geometry (page, kind, fill, x0, y0, x1, y1, text) and items (page, stem, choices).

    Tiers, the first that gives an option counts: ``green`` (the text inside a green stroke, likeness 0.45 or more),
    ``band`` (black text in the first answer band of a definition card, 0.72), ``tile`` (tiles from the darkest on,
    0.48, those that rather show the stem left out), ``tile_weak`` (0.35), ``band_any``. Of tiles wider than 350 and
    others, two or more of the wide ones, else of the narrow ones, else all count. Pages without any tier have no row.
    """
    texts = geometry.where("kind = 'text'")
    spans = texts.select("page", F.col("text").alias("said"), F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1"))
    box = F.struct("y0", "x0", "y1", "x1").alias("box")
    strokes = geometry.where((F.col("kind") == "stroke") & is_green(F.col("fill")[0], F.col("fill")[1], F.col("fill")[2])).select("page", box, "x0", "y0", "x1", "y1", F.lit(0.0).alias("light"))
    green = strokes.groupBy("page").agg(F.min_by(F.struct(*strokes.columns[1:]), "box").alias("s")).select("page", "s.*")
    tiles = geometry.where("kind = 'tile' and x1 - x0 >= 150 and y1 - y0 between 30 and 130 and y0 between 200 and 580 and fill <> array(1D, 1D, 1D)")
    tiles = tiles.select("page", box, "x0", "y0", "x1", "y1", luminance(F.col("fill")[0], F.col("fill")[1], F.col("fill")[2]).alias("light"))
    page = Window.partitionBy("page")
    wide, narrow = F.count_if(F.col("x1") - F.col("x0") > 350).over(page), F.count_if(F.col("x1") - F.col("x0") <= 350).over(page)
    is_wide = F.col("x1") - F.col("x0") > 350
    pool = tiles.withColumn("wide", wide).withColumn("narrow", narrow).where(F.when(F.col("wide") >= 2, is_wide).when(F.col("narrow") >= 2, ~is_wide).otherwise(True)).drop("wide", "narrow")
    black = texts.where("y0 between 85 and 210 and length(trim(text)) >= 2 and trim(text) <> 'Definition' and (fill is null or fill = array(0D, 0D, 0D))")
    cards = texts.where("text like '%Definition%'").select("page").distinct()
    bands = black.join(cards, "page").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("parts"))
    bands = bands.select("page", squeeze(F.lower(F.array_join(F.transform("parts", lambda x: F.trim(x["text"])), " "))).alias("text"))
    seen = [
        _cells(spans, green).select("page", F.lit("green").alias("of"), "light", "box", "text"), _cells(spans, pool).select("page", F.lit("tile").alias("of"), "light", "box", "text"),
        bands.select("page", F.lit("band").alias("of"), F.lit(0.0).alias("light"), F.lit(None).cast(tiles.schema["box"].dataType).alias("box"), "text"),
    ]
    read = reduce(DataFrame.unionByName, seen).join(items.select("page", "stem", "choices"), "page").withColumn("o", _option_of(F.col("text"), F.col("stem"), F.col("choices"))).where("o.letter is not null")
    stem_like = "o.stem_score > 0.72 and o.score < 0.55"
    tier = F.expr(
        f"case when of = 'green' and o.score >= 0.45 then 1 when of = 'band' and length(text) >= 8 and o.score >= 0.72 then 2 when of = 'tile' and not ({stem_like}) and o.score >= 0.48 then 3"
        " when of = 'tile' and o.score >= 0.35 then 4 when of = 'band' then 5 end"
    )
    ranked = read.withColumn("tier", tier).where("tier is not null").groupBy("page").agg(F.min_by(F.struct("tier", "o"), F.struct("tier", "light", "box")).alias("b"))
    names = F.array(*[F.lit(x) for x in ("green", "band", "tile", "tile_weak", "band_any")])
    return ranked.select("page", F.col("b.o.letter").alias("letter"), F.col("b.o.score").alias("score"), names[F.col("b.tier") - 1].alias("tier"))


def is_pdf(content: Column, content_type: Column) -> Column:
    """Whether a fetched page is a PDF, by its first bytes or its content type."""
    return F.coalesce(F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-", F.lit(False)) | F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False))
