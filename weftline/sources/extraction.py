"""Entity and relation extraction: an injected client, or an offline rule.

An extractor is anything with `extract(text) -> (entities, relations)`, lists of
dicts with name, type, description and source, target, relation, description.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from itertools import combinations
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.schema import EXTRACTION
from weftline.session import slices, workers_find_us


class Extractor(Protocol):
    def extract(self, text: str) -> tuple[list[dict], list[dict]]: ...


class OfflineExtractor:
    """Capitalised words that recur are entities; two in one sentence are related."""

    def __init__(self, least: int = 2):
        self.least = least

    def extract(self, text: str) -> tuple[list[dict], list[dict]]:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s]
        found = [sorted(set(re.findall(r"[^\W\d_a-z][^\W\d_]{3,}", s))) for s in sentences]
        counts: dict[str, int] = {}
        for names in found:
            for n in names:
                counts[n] = counts.get(n, 0) + 1
        kept = sorted((n for n, c in counts.items() if c >= self.least), key=lambda n: (-counts[n], n))
        chosen = set(kept)
        entities = [{"name": n, "type": "CONCEPT", "description": f"in {counts[n]} sentences"} for n in kept]
        relations, seen = [], set()
        for s, names in zip(sentences, found):
            for a, b in combinations([n for n in names if n in chosen], 2):
                if (a, b) not in seen:
                    seen.add((a, b))
                    relations.append({"source": a, "target": b, "relation": "CO_OCCURS", "description": s})
        return entities, relations


#: Marks of errors that pass, and what an error costs.
BUSY = ("503", "429", "UNAVAILABLE", "RESOURCE_EXHAUSTED")
TRIES, WAIT = 3, 2.0


class Caller:
    """Asks `ask(model, prompt) -> text`: an error that passes is tried again after a wait, any other ends it; then a second model has one try."""

    def __init__(self, ask: Callable[[str, str], str], model: str, *, fallback: str | None = None, tries: int = TRIES, wait: Callable[[int], float] = lambda k: WAIT * (k + 1), sleep: Callable[[float], None] = time.sleep):
        self.ask, self.model, self.fallback, self.tries, self.wait, self.sleep = ask, model, fallback, tries, wait, sleep

    def call(self, prompt: str) -> tuple[str | None, str]:
        """(answer or None, the model that gave it)."""
        for attempt in range(self.tries):
            try:
                return self.ask(self.model, prompt), self.model
            except Exception as e:  # noqa: BLE001  clients raise what they like
                if attempt == self.tries - 1 or not any(b in str(e) for b in BUSY):
                    break
                self.sleep(self.wait(attempt))
        if self.fallback and self.fallback != self.model:
            try:
                return self.ask(self.fallback, prompt), f"{self.model} -> fallback: {self.fallback}"
            except Exception:  # noqa: BLE001
                pass
        return None, self.model


class ClientExtractor(Caller):
    """Entities and relations from a client's JSON answer; none from an answer that fails or is no JSON."""

    def extract(self, text: str) -> tuple[list[dict], list[dict]]:
        answer, _ = self.call("List the named entities of the text and the relations between them as JSON.\n\n" + text)
        try:
            data = json.loads(answer) if answer else {}
        except ValueError:
            data = {}
        data = data if isinstance(data, dict) else {}
        return data.get("entities") or [], data.get("relations") or []


Triple = tuple[str, str, str]


def read_triples(answer: str | None, *, keep_empty: bool = False) -> list[Triple] | None:
    """Triples of a JSON answer {"triples": [{subject, predicate, object}]}, the predicate in lower case; None if it is none."""
    try:
        rows = [(t["subject"], t["predicate"], t["object"]) for t in json.loads(answer or "")["triples"]]
        return [(s.strip(), p.strip().lower(), o.strip()) for s, p, o in rows if keep_empty or (s and p and o)]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class DirectTriples:
    """One question for all triples of a text."""

    def __init__(self, caller: Caller):
        self.caller = caller

    def triples(self, text: str) -> list[Triple]:
        return read_triples(self.caller.call(f"State the facts of the text as JSON triples of short subject, predicate and object.\n\n{text}")[0]) or []


class RefinedTriples(DirectTriples):
    """A second question unites names of one thing and drops repeats; without an answer the first ones stay."""

    def triples(self, text: str) -> list[Triple]:
        found = super().triples(text)
        if not found:
            return []
        better = read_triples(self.caller.call(f"Unite different names of one thing, unify predicates and drop repeats in these JSON triples.\n\n{json.dumps(found, ensure_ascii=False)}")[0])
        return found if better is None else better


class VerifiedTriples(DirectTriples):
    """Candidates first, then only those that a second look at the text supports; without an answer all candidates stay."""

    def triples(self, text: str) -> list[Triple]:
        found = read_triples(self.caller.call(f"State only what the text says literally, definitions first, as JSON triples.\n\n{text}")[0], keep_empty=True)
        if not found:
            return []
        sure = read_triples(self.caller.call(f"Keep the triples that the text supports.\n\n{text}\n\n{json.dumps(found, ensure_ascii=False)}")[0])
        return found if sure is None else sure


class GraphTriples:
    """Triples of an entity and relation extractor: ends by their names, types in lower case with hyphens."""

    def __init__(self, extractor: Extractor):
        self.extractor = extractor

    def triples(self, text: str) -> list[Triple]:
        entities, relations = self.extractor.extract(text)
        names = {_plain_id(e["name"]): e["name"] for e in reversed(entities)}
        end = lambda x: names.get(_plain_id(x), x)
        return [(end(r["source"]), r["relation"].lower().replace("_", "-"), end(r["target"])) for r in relations]


def _plain_id(name: str) -> str:
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name.strip().lower()))


#: Strategies by name: each makes an object with triples(text) from a caller.
STRATEGIES: dict[str, Callable[[Caller], object]] = {
    "LLMGraphTransformer": DirectTriples,
    "KGGen": RefinedTriples,
    "GT2KG": VerifiedTriples,
    "GraphTriples": lambda caller: GraphTriples(ClientExtractor(caller.ask, caller.model, fallback=caller.fallback, tries=caller.tries, wait=caller.wait, sleep=caller.sleep)),
}


def extract_triples(texts: DataFrame, caller: Callable[[], Caller], methods: list[str] | None = None) -> DataFrame:
    """(run, doc, idx, subject, predicate, object) of (doc, text) by each strategy named; unknown names are skipped.

    A run is named after strategy and model. One caller a task.
    """
    workers_find_us(texts.sparkSession)
    chosen = [m for m in (methods or list(STRATEGIES)) if m in STRATEGIES]

    def run(batches):
        asked = caller()
        made = {m: STRATEGIES[m](asked) for m in chosen}
        for batch in batches:
            rows = [(f"{m} ({asked.model})", doc, i, *t) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m, s in made.items() for i, t in enumerate(s.triples(text or ""))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["run", "doc", "idx", "subject", "predicate", "object"])

    return texts.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(run, "run string, doc string, idx int, subject string, predicate string, object string")


def _texts(rows, names: tuple[str, ...]) -> list[dict]:
    """Objects of an answer with the given keys as texts; whatever else stands in it goes."""
    told = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return [{n: told(row.get(n)) for n in names} for row in (rows if isinstance(rows, list) else []) if isinstance(row, dict)]


def extract(chunks: DataFrame, make: Callable[[], Extractor] = OfflineExtractor, seen=None) -> DataFrame:
    """`chunks` (id, text, ...) with `answer`: the raw entities and relations. One extractor a task; `seen`: an accumulator of chunks."""
    workers_find_us(chunks.sparkSession)
    at = chunks.columns.index("text")
    ends, links = (tuple(f.name for f in EXTRACTION[name].dataType.elementType) for name in ("entities", "relations"))
    of = lambda names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
    kind = pa.struct([("entities", of(ends)), ("relations", of(links))])

    def run(batches):
        extractor = make()
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text in batch.column(at).to_pylist():
                    e, r = extractor.extract(text or "")
                    out.append({"entities": _texts(e, ends), "relations": _texts(r, links)})
                if seen is not None:
                    seen.add(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "answer"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("answer", EXTRACTION)]))


def clean(answered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per chunk: distinct entities (the first of an id wins) and relations (the last of a key wins).

    Entities without an id go; so do relations with a missing or equal end. Ends
    that no entity has become entities of type CONCEPT.
    """
    rel = answered.select(F.col("id").alias("chunk_id"), F.posexplode("answer.relations").alias("pos", "r"))
    rel = rel.select("chunk_id", "pos", X.canonical_id(F.col("r.source")).alias("src"), X.canonical_id(F.col("r.target")).alias("tgt"), X.relation_type(F.col("r.relation")).alias("type"), X.strip(F.col("r.description")).alias("description"), X.strip(F.col("r.source")).alias("src_name"), X.strip(F.col("r.target")).alias("tgt_name"))
    rel = rel.where((F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt")))
    ent = answered.select(F.col("id").alias("chunk_id"), F.posexplode("answer.entities").alias("pos", "e"))
    ent = ent.select("chunk_id", F.lit(0).alias("late"), F.col("pos").cast("long").alias("pos"), X.canonical_id(F.col("e.name")).alias("id"), X.strip(F.col("e.name")).alias("name"), F.upper(X.strip(F.col("e.type"))).alias("type"), X.strip(F.col("e.description")).alias("description"))
    ends = rel.select("chunk_id", F.lit(1).alias("late"), F.explode(F.array(F.struct((2 * F.col("pos")).cast("long").alias("pos"), F.col("src").alias("id"), F.col("src_name").alias("name")), F.struct((2 * F.col("pos") + 1).cast("long").alias("pos"), F.col("tgt").alias("id"), F.col("tgt_name").alias("name")))).alias("x"))
    ends = ends.select("chunk_id", "late", "x.pos", "x.id", "x.name", F.lit("CONCEPT").alias("type"), F.lit("").alias("description"))
    order = F.struct("late", "pos")
    first = ent.where("id <> ''").unionByName(ends).groupBy("chunk_id", "id").agg(F.min_by(F.struct("name", "type", "description"), order).alias("v"), F.min(order).alias("at"))
    entities = first.select("chunk_id", "id", "v.name", "v.type", "v.description", F.row_number().over(Window.partitionBy("chunk_id").orderBy("at")).alias("pos"))
    last = rel.groupBy("chunk_id", "src", "tgt", "type").agg(F.max_by("description", "pos").alias("description"), F.min("pos").alias("pos"))
    return entities, last
