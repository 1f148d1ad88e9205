"""Translation runs: policy, skipping, memory, dedup within the run, batches of segments, evidence."""

from __future__ import annotations

import re
import resource
import sys
import time
import types
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import CORE_MARK, cache_key, normalize, protect, restore_one, segment, skips_translation
from quire.operators.glossary import Glossary, matches, prepare
from quire.plans.options import TranslationOptions

MEMORY = "cache_key string, translated_text string, created_at timestamp"


class Translator(Protocol):
    """A model, loaded once for each task that has work."""

    def count_tokens(self, text: str) -> int: ...

    def translate_batch(self, texts: list[str]) -> list[str]: ...


class PrefixTranslator:
    """A stand-in: "RU " before the text; a token per word and two more."""

    def count_tokens(self, text: str) -> int:
        return len(text.split()) + 2

    def translate_batch(self, texts: list[str]) -> list[str]:
        return [f"RU {t}" for t in texts]


class _Held(types.ModuleType):
    """What a worker process holds: one model and its identity."""

    def __init__(self) -> None:
        super().__init__("quire_worker_model")
        self.identity, self.model, self.made = "", None, 0


def worker_model(translator: type, identity: str) -> Translator:
    """The model of this process: made once for an identity and kept for all its tasks; a model of another identity takes its place, so that a process never holds two.

    Functions reach workers by value, so what a process keeps is put where all of them find it: among the loaded modules.
    """
    held = sys.modules.setdefault("quire_worker_model", _Held())
    if held.identity != identity:
        held.model = None  # free the old one before the new one is loaded
        held.identity, held.model, held.made = identity, translator(), held.made + 1
    return held.model


@dataclass(frozen=True)
class ModelRuntime:
    """A model for any number of runs and documents: a translator and the options that are its identity. Runs of other options are refused."""

    translator: type
    options: TranslationOptions = TranslationOptions()

    @property
    def identity(self) -> str:
        o = self.options
        return "\0".join((self.translator.__module__, self.translator.__qualname__, o.backend, o.model, o.source, o.target))

    def check(self, o: TranslationOptions) -> None:
        differ = [f for f in ("backend", "model", "source", "target", "token_limit") if getattr(o, f) != getattr(self.options, f)]
        if differ:
            raise ValueError(f"the shared model has another {', '.join(differ)}")

    def model(self) -> Translator:
        return worker_model(self.translator, self.identity)

    def count_tokens(self, text: str) -> int:
        """Counted in the worker, by the model that it translates with; the driver makes none."""
        return self.model().count_tokens(text)


def peak_memory() -> float:
    """Megabytes that this process had at most."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1024 if sys.platform != "darwin" else 1 << 20)


class Measured:
    """A model that counts: calls, texts and seconds, beside what another one gives."""

    def __init__(self, translator: Translator):
        self.translator, self.calls, self.texts, self.seconds = translator, 0, 0, 0.0

    def count_tokens(self, text: str) -> int:
        return self.translator.count_tokens(text)

    def translate_batch(self, texts: list[str]) -> list[str]:
        began = time.perf_counter()
        try:
            return self.translator.translate_batch(texts)
        finally:
            self.calls, self.texts, self.seconds = self.calls + 1, self.texts + len(texts), self.seconds + time.perf_counter() - began


def halving(translator: Translator, texts: list[str]) -> list[str]:
    """A batch that doesn't fit in memory is tried in halves; a single text that doesn't fit is an error."""
    try:
        return translator.translate_batch(texts)
    except MemoryError:
        if len(texts) < 2:
            raise
        half = len(texts) // 2
        return halving(translator, texts[:half]) + halving(translator, texts[half:])


def policies(paragraph_blocks: DataFrame, classified: DataFrame) -> DataFrame:
    """Of each paragraph: translate without classified blocks, their policy if they agree, else preserve. paragraph_blocks: doc, para, block_id."""
    found = paragraph_blocks.join(classified.select("doc", "block_id", "policy"), ["doc", "block_id"], "left").groupBy("doc", "para").agg(F.collect_set("policy").alias("p"))
    return found.select("doc", "para", F.when(F.size("p") == 0, "translate").when(F.size("p") == 1, F.col("p")[0]).otherwise("preserve").alias("policy"))


def plan_units(units: DataFrame, memory: DataFrame | None, o: TranslationOptions, glossary: Glossary | None = None, composed: bool = False) -> DataFrame:
    """The units with normalized, cache_key, cached and status: skipped, hit (in memory, or of an earlier unit with the same text) or miss. units: unit_id, unit_order, text, policy."""
    rows = units.withColumn("normalized", normalize(F.col("text"), composed))
    rows = rows.withColumn("cache_key", cache_key(F.col("normalized"), o.backend, o.model, o.source, o.target, glossary.fingerprint() if glossary else None))
    skipped = (F.col("policy") != "translate") | skips_translation(F.coalesce("text", F.lit("")), composed)
    rows = rows.withColumn("skipped", skipped)
    if memory is None:
        rows = rows.withColumn("cached", F.lit(None).cast("string"))
    else:
        rows = rows.join(memory.select("cache_key", F.col("translated_text").alias("cached")), "cache_key", "left")
    # the first of each text by order: an aggregate that is partly done before the shuffle, so a very frequent text is no hot key
    first = rows.where(~F.col("skipped") & F.col("cached").isNull()).groupBy("cache_key").agg(F.min("unit_order").alias("first_order"))
    rows = rows.join(first, "cache_key", "left")
    status = F.when(F.col("skipped"), "skipped").when(F.col("cached").isNotNull(), "hit").when(F.col("unit_order") == F.col("first_order"), "miss").otherwise("hit")
    return rows.withColumn("status", status).drop("first_order")


def translate_misses(misses: DataFrame, o: TranslationOptions, translator: type | ModelRuntime = PrefixTranslator, glossary: Glossary | None = None, measures: bool = False) -> DataFrame:
    """cache_key, translated, n_segments, forced: of the texts that need the model. A distinct text is translated once.

    A text that the model fails on is a row with its error, and no other suffers. measures: also calls and seconds of the model and
    peak_mb of the worker; those of an Arrow batch stand at its first row.
    """
    runtime = translator if isinstance(translator, ModelRuntime) else ModelRuntime(translator, o)
    runtime.check(o)
    rows = misses.select("cache_key", "text")
    if glossary is not None:
        rows = rows.withColumn("found", matches(F.col("text"), glossary)).withColumn("g", prepare(F.col("text"), F.col("found"), glossary)).select("cache_key", "g.text", F.col("g.tokens").alias("terms"))
    rows = rows.withColumn("p", protect(F.col("text"))).withColumn("s", segment(F.col("p.text"), o.token_limit, runtime.count_tokens))

    def translated(model: Measured, texts: list[str]) -> list[str | Exception]:
        """In batches; of a batch that fails each text by itself, so that the error is that of one text."""
        try:
            return halving(model, texts)
        except Exception as e:  # the model's own errors are data here
            return [e] if len(texts) == 1 else [y for t in texts for y in translated(model, [t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core = re.compile(CORE_MARK)
        for batch in batches:
            if not len(batch):
                continue
            model = Measured(runtime.model())
            texts = [x["text"] for segments in batch["segments"] for x in segments]
            done = [y for i in range(0, len(texts), o.batch_size) for y in translated(model, texts[i : i + o.batch_size])]
            at, out, errors = 0, [], []
            for segments, *marked in zip(batch["segments"], batch["tokens"], *([batch["terms"]] if glossary else []), strict=True):
                parts = done[at : at + len(segments)]
                at += len(segments)
                failed = next((p for p in parts if isinstance(p, Exception)), None)
                text = None if failed else "".join(d + x["separator"] for d, x in zip(parts, segments, strict=True))
                # tokens come back before glossary terms, whose marks are themselves tokens
                for marks in marked:
                    text = None if text is None else restore_one(text, marks, core)
                out.append(text)
                errors.append(f"{type(failed).__name__}: {failed}" if failed else "ValueError: a protected token is lost" if text is None else None)
            made = batch[["cache_key"]].assign(translated=out, n_segments=batch["segments"].map(len), forced=batch["forced"], error=errors)
            if measures:
                first = [1.0] + [0.0] * (len(batch) - 1)
                made = made.assign(calls=[int(f) * model.calls for f in first], seconds=[f * model.seconds for f in first], peak_mb=[f * peak_memory() for f in first])
            yield made

    kept = rows.select("cache_key", F.col("s.segments").alias("segments"), F.col("s.forced").alias("forced"), F.col("p.tokens").alias("tokens"), *(["terms"] if glossary else []))
    return kept.mapInPandas(run, "cache_key string, translated string, n_segments int, forced boolean, error string" + (", calls long, seconds double, peak_mb double" if measures else ""))


def finish_units(planned: DataFrame, translated: DataFrame) -> DataFrame:
    """Every unit with its translation, or the error that it failed with: skipped ones keep (or, by policy, lose) their text, hits and misses get the memory's or the run's."""
    rows = planned.join(translated, "cache_key", "left")
    own = F.when(F.col("policy").isin("translate", "preserve"), F.col("text")).otherwise("")
    return rows.withColumn("translated", F.when(F.col("status") == "skipped", own).otherwise(F.coalesce("cached", "translated"))).drop("cached", "skipped")


def new_memory(translated: DataFrame) -> DataFrame:
    return translated.where("translated IS NOT NULL").select("cache_key", F.col("translated").alias("translated_text"), F.current_timestamp().alias("created_at"))


def merge_memory(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """An upsert: the latest row of each key."""
    both = memory.unionByName(fresh)
    return both.groupBy("cache_key").agg(F.max_by("translated_text", "created_at").alias("translated_text"), F.max("created_at").alias("created_at"))


def run_counters(finished: DataFrame) -> DataFrame:
    s = F.col("status")
    return finished.agg(F.count("*").alias("n_units"), F.count_if(s == "skipped").alias("n_skipped"), F.count_if(s == "hit").alias("n_hits"), F.count_if(s == "miss").alias("n_misses"), F.coalesce(F.sum(F.when(s == "miss", F.col("n_segments"))), F.lit(0)).cast("long").alias("n_segments"))


def batches_of(segments: DataFrame, order: str, size: int) -> DataFrame:
    """The micro-batch of each segment, where the number of calls matters; within a partition key the order is total."""
    return segments.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc").orderBy(order)) - 1) / size))


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to do: units without a finished row of the same text."""
    return units.join(done.select("unit_id", "text"), ["unit_id", "text"], "left_anti")
