"""Evaluation texts leaking into training text: documents that hold a long run of words of a held-out question.

The held-out items make a BM25 inverted index whose posting lists are cut into blocks with the largest
weight of each (block-max). Every passage of every document queries it by WAND: documents of the index
are skipped while the upper bounds of their remaining terms stay below the threshold. Weights are scaled
by the least weight that any RUN consecutive words of an item can have, so score >= 1 holds for every
passage with such a run and nothing is lost. Passages overlap by RUN - 1 words. What is retrieved is
verified word by word; overlap of the choices is reported beside it.

Defined results: null texts hold nothing; items with fewer than RUN words or a null question are in
no document; repeated items are each reported; a document is reported once for an item.
The index is built on the driver from at most MAX_ITEMS held-out items at a time. A larger set is taken in
several indexes of that size, one after the other: each has one pass over the corpus and its hits are written
before the next is read, so no more than one index is ever held. What decides a hit is the table of an
index's runs of RUN words; the scores only say which items to look up.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

RUN = 12
PASSAGE = 60
BLOCK = 16
MAX_ITEMS = 20_000
K1, B = 1.2, 0.75
_WORDS = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def terms(w: list[str]) -> list[str]:
    """The terms of the index: neighbouring pairs of words, far rarer than words, so bounds end most queries at once."""
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


class Index:
    """Posting lists by term: item numbers, scaled weights, and the largest weight of each block."""

    def __init__(self, items: list[tuple[str, str | None]], run: int = RUN):
        self.run = run
        kept = [(i, w) for i, q in items if len(w := words(q)) >= run]
        self.ids = [i for i, _ in kept]
        texts = [w for _, w in kept]
        n = len(texts)
        df = Counter(t for w in texts for t in set(terms(w)))
        mean = sum(map(len, texts)) / max(1, n)
        self.runs: dict[tuple[str, ...], set[int]] = defaultdict(set)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for d, w in enumerate(texts):
            tf = Counter(terms(w))
            weight = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()
            }
            spans = [tuple(w[i : i + run]) for i in range(len(w) - run + 1)]
            least = min(sum(weight[t] for t in set(terms(s))) for s in spans)
            for s in spans:
                self.runs[s].add(d)
            for t, x in weight.items():
                postings[t].append((d, x / least))
        self.docs = {t: [d for d, _ in p] for t, p in postings.items()}
        self.weights = {t: [x for _, x in p] for t, p in postings.items()}
        self.best = {t: max(w) for t, w in self.weights.items()}
        self.block_best = {t: [max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for t, w in self.weights.items()}

    def retrieve(self, query: set[str]) -> list[int]:
        """Item numbers whose score for the query's terms reaches 1, by block-max WAND."""
        lists = [t for t in query if t in self.best]
        if sum(self.best[t] for t in lists) < 1 - 1e-9:
            return []
        at, found, end = dict.fromkeys(lists, 0), [], len(self.ids)
        while lists:
            lists.sort(key=lambda t: self.docs[t][at[t]])
            bound, pivot = 0.0, -1
            for k, t in enumerate(lists):
                bound += self.best[t]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = self.docs[lists[pivot]][at[lists[pivot]]]
            while pivot + 1 < len(lists) and self.docs[lists[pivot + 1]][at[lists[pivot + 1]]] == doc:
                pivot += 1
            block_bound, reach = 0.0, end
            for t in lists[: pivot + 1]:
                docs, k = self.docs[t], at[t] // BLOCK
                while docs[min((k + 1) * BLOCK, len(docs)) - 1] < doc:
                    if (k + 1) * BLOCK >= len(docs):
                        k = -1
                        break
                    k += 1
                if k >= 0:
                    block_bound += self.block_best[t][k]
                    reach = min(reach, docs[min((k + 1) * BLOCK, len(docs)) - 1] + 1)
            target = doc
            if block_bound >= 1 - 1e-9:
                score = 0.0
                for t in lists[: pivot + 1]:
                    docs, i = self.docs[t], at[t]
                    while i < len(docs) and docs[i] < doc:
                        i += 1
                    at[t] = i
                    if i < len(docs) and docs[i] == doc:
                        score += self.weights[t][i]
                if score >= 1 - 1e-9:
                    found.append(doc)
                target = doc + 1
            else:
                # No item before the end of these blocks or the next list's item can reach the threshold.
                following = self.docs[lists[pivot + 1]][at[lists[pivot + 1]]] if pivot + 1 < len(lists) else end
                target = max(doc + 1, min(reach, following))
            for t in lists[: pivot + 1]:
                docs, i = self.docs[t], at[t]
                while i < len(docs) and docs[i] < target:
                    i += 1
                at[t] = i
            lists = [t for t in lists if at[t] < len(self.docs[t])]
        return found

    def items_in(self, text: str | None) -> set[int]:
        w = words(text)
        found: set[int] = set()
        step = PASSAGE - self.run + 1
        for start in range(0, max(1, len(w) - self.run + 1), step):
            passage = w[start : start + PASSAGE]
            wanted = [d for d in self.retrieve(set(terms(passage))) if d not in found]
            if wanted:
                spans = {tuple(passage[i : i + self.run]) for i in range(len(passage) - self.run + 1)}
                held = set().union(*(self.runs[s] for s in spans if s in self.runs))
                found.update(held.intersection(wanted))
        return found


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, id: the items of which a document holds ``run`` or more consecutive words of the question."""
    held = items.select("id", "question").where("id is not null and question is not null").orderBy("id", "question").toLocalIterator()
    source = documents.select("doc_id", "text").where("text is not null")
    kind = items.schema["id"].dataType.simpleString()

    def scanned(index: Index) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = [(d, index.ids[i]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i in sorted(index.items_in(t))]
                yield pd.DataFrame(hits, columns=["doc_id", "id"])

        # A large closure is broadcast by Spark itself.
        return source.mapInPandas(scan, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, id {kind}")

    whole, rows = None, [(r.id, r.question) for r in islice(held, MAX_ITEMS)]
    while whole is None or rows:
        part, rows = scanned(Index(rows, run)), [(r.id, r.question) for r in islice(held, MAX_ITEMS)]
        if whole is not None or rows:
            part = cut(part)
        whole = part if whole is None else whole.unionByName(part)
    return whole.distinct()


def leaked_items(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """id, n_documents, n_with_choice: how many documents hold an item, and how many one of its choices as well."""
    squeezed = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    answers = items.select("id", F.transform("choices", lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(" "))).alias("answers"))
    texts = documents.select("doc_id", squeezed(F.col("text")).alias("body"))
    joined = found.join(F.broadcast(answers) if items.limit(MAX_ITEMS + 1).count() <= MAX_ITEMS else answers, "id").join(texts, "doc_id")
    return joined.groupBy("id").agg(
        F.count_distinct("doc_id").alias("n_documents"),
        F.count_distinct(F.when(F.exists("answers", lambda a: (F.length(a) > 2) & F.col("body").contains(a)), F.col("doc_id"))).alias("n_with_choice"),
    )
