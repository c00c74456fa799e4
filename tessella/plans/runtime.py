"""From a catalog to DataFrame plans: aliases, shared models, fused and pruned passes.

The builder decides before Spark sees the plan what Catalyst cannot: that three heads of one
model are one pass, that heads nobody reads are not made, and that rows which need no model do
not enter Python.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import PROVIDERS, TASKS, normalize_whole_floats
from ..operators.reliability import RETRYABLE
from ..providers import base, deterministic, onnx  # noqa: F401  the bundled ones register themselves

RESULTS = {
    "embed": "array<float>", "embed_image": "array<float>", "embed_sparse": "array<struct<term:bigint,weight:float>>", "embed_multi_vector": "array<array<float>>",
    "embed_hybrid": "struct<dense:array<float>,sparse:array<struct<term:bigint,weight:float>>,multi_vector:array<array<float>>>", "generate": "string", "rerank": "double",
    "embed_audio": "array<float>", "embed_multimodal": "array<float>", "raw": "map<string,array<double>>",
    "document_extract": "array<struct<reading_order:int,kind:string,content:string>>", "transcribe": "array<struct<start_ms:bigint,end_ms:bigint,text:string>>",
    "ocr": "struct<text:string,blocks:array<struct<text:string,confidence:double>>>",
    "nlp": "struct<tokens:array<struct<text:string,start:int,end:int,ner:string,head:int,word:int>>,sentences:array<struct<first:int,last:int,start:int,end:int>>,acts:array<struct<sentence:int,label:string,confidence:double>>,entities:array<struct<label:string,first:int,last:int,start:int,end:int,text:string>>>",
}
HEADS = ("dense", "sparse", "multi_vector")


class CatalogError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    alias: str
    task: str
    provider_id: str
    model_id: str
    revision: str | None = None
    warmup: str = "lazy"
    required: bool = False
    timeout: int | None = None
    load_timeout: int | None = 600
    max_attempts: int = 1
    initial_backoff_ms: int = 100
    options: str = "{}"

    @staticmethod
    def of(raw: dict) -> "Spec":
        retry = raw.get("retry") or {}
        known = {k: raw[k] for k in ("alias", "task", "provider_id", "model_id", "revision", "warmup", "required", "timeout", "load_timeout") if raw.get(k) is not None}
        options = json.dumps(normalize_whole_floats(raw.get("options") or {}), sort_keys=True)
        return Spec(**known, max_attempts=retry.get("max_attempts", 1), initial_backoff_ms=retry.get("initial_backoff_ms", 100), options=options)

    def key(self) -> tuple:
        return self.task, self.provider_id, self.model_id, self.revision, self.options


@functools.lru_cache(maxsize=16)
def _loaded(key: tuple):
    """One object for each runtime key and Python worker, made when first used."""
    task, provider_id, model_id, _, options = key
    return base.provider(provider_id).load(task, model_id, json.loads(options))


class CallTimeout(TimeoutError):
    kind = "timeout"


def _within(seconds: float | None, call):
    """call(), given up after seconds (its thread ends on its own)."""
    if not seconds:
        return call()
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(seconds)
    except FutureTimeout:
        raise CallTimeout(f"no answer within {seconds} s") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _call(spec: Spec, batch: list):
    """A batch with the spec's timeout for each attempt and its retries; an error that no attempt mends is raised."""
    model = _within(spec.load_timeout, lambda: _loaded(spec.key()))
    for attempt in range(1, spec.max_attempts + 1):
        try:
            return _within(spec.timeout, lambda: model.run(batch))
        except Exception as e:
            if attempt == spec.max_attempts or getattr(e, "kind", None) not in RETRYABLE:
                raise
            time.sleep(spec.initial_backoff_ms * 2 ** (attempt - 1) / 1000)


@dataclass
class Runtime:
    """A checked catalog; every method gives columns or DataFrames, and loads nothing on the driver but prefetch()."""

    specs: dict[str, Spec] = field(default_factory=dict)
    verified: dict[str, str | None] = field(default_factory=dict)

    @staticmethod
    def build(catalog: list[dict]) -> "Runtime":
        r = Runtime()
        for raw in catalog:
            r.register(Spec.of(raw))
        for s in r.specs.values():
            if s.warmup == "eager":
                r.prefetch(s.alias)
        return r

    def register(self, spec: Spec) -> None:
        if not spec.alias or "/" not in spec.alias:
            raise CatalogError(f"alias {spec.alias!r} is not task/name")
        if spec.alias in self.specs:
            raise CatalogError(f"duplicate alias {spec.alias}")
        if spec.task not in TASKS:
            raise CatalogError(f"unknown task {spec.task}")
        if spec.provider_id not in PROVIDERS and spec.provider_id not in base.registered():
            raise CatalogError(f"unknown provider {spec.provider_id}")
        if spec.timeout == 0 or spec.load_timeout == 0:
            raise CatalogError("timeout is zero")
        self.specs[spec.alias] = spec

    def aliases(self) -> list[str]:
        return sorted(self.specs)

    def __contains__(self, alias: str) -> bool:
        return alias in self.specs

    def spec(self, alias: str, task: str | None = None) -> Spec:
        if alias not in self.specs:
            raise LookupError(f"no alias {alias}")
        s = self.specs[alias]
        if task and s.task != task:
            raise CatalogError(f"{alias} is for {s.task}, not {task}")
        return s

    def prefetch(self, *aliases: str) -> None:
        """Loads aliases (all without any) here; the first failure is raised."""
        for a in aliases or self.aliases():
            _loaded(self.spec(a).key())

    def prefetch_report(self, *aliases: str) -> list[tuple[str, str | None]]:
        """(alias, error) in order; goes on after failures."""
        out = []
        for a in aliases or self.aliases():
            try:
                self.prefetch(a)
                out.append((a, None))
            except Exception as e:
                out.append((a, str(e)))
        return out

    def verify(self, *aliases: str, at_once: int = 8, most: float = 30.0) -> list[tuple[str, str | None]]:
        """(alias, error) of aliases (all without any), in order; so many at once, each within its timeout or most seconds.

        A provider's object that has verify() is asked; loading it is the check of one that has not.
        """

        def one(alias: str) -> tuple[str, str | None]:
            try:
                s = self.spec(alias)
                _within(min(s.timeout or most, most), lambda: getattr(_loaded(s.key()), "verify", lambda: None)())
                return alias, None
            except Exception as e:
                return alias, getattr(e, "kind", None) or str(e)

        with ThreadPoolExecutor(at_once) as pool:
            out = list(pool.map(one, aliases or self.aliases()))
        self.verified.update(out)
        return out

    def providers(self) -> list[tuple[str, int, str]]:
        """(provider, aliases, health) by id: "unhealthy" if all verified aliases failed, "degraded" if some did."""
        out = []
        for p in sorted({s.provider_id for s in self.specs.values()}):
            mine = [a for a in self.aliases() if self.specs[a].provider_id == p]
            checked = [self.verified[a] for a in mine if a in self.verified]
            failed = sum(e is not None for e in checked)
            out.append((p, len(mine), "healthy" if not failed else "unhealthy" if failed == len(checked) else "degraded"))
        return out

    def shared(self) -> dict[tuple, list[str]]:
        """Aliases by the model that they share."""
        out: dict[tuple, list[str]] = {}
        for a in self.aliases():
            out.setdefault(self.specs[a].key(), []).append(a)
        return out

    def _udf(self, spec: Spec, result: str):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(_call(spec, list(b)), dtype=object) if len(b) else pd.Series([], dtype=object)

        return F.pandas_udf(run, result)

    def embed(self, alias: str, text: Column) -> Column:
        """One vector for each text, by any alias that has a dense head."""
        s = self.spec(alias)
        return self.hybrid(alias, text, ("dense",))["dense"] if s.task == "embed_hybrid" else self._udf(self.spec(alias, "embed"), RESULTS["embed"])(text)

    def embed_sparse(self, alias: str, text: Column) -> Column:
        s = self.spec(alias)
        return self.hybrid(alias, text, ("sparse",))["sparse"] if s.task == "embed_hybrid" else self._udf(self.spec(alias, "embed_sparse"), RESULTS["embed_sparse"])(text)

    def embed_multi_vector(self, alias: str, text: Column) -> Column:
        s = self.spec(alias)
        return self.hybrid(alias, text, ("multi_vector",))["multi_vector"] if s.task == "embed_hybrid" else self._udf(self.spec(alias, "embed_multi_vector"), RESULTS["embed_multi_vector"])(text)

    def hybrid(self, alias: str, text: Column, heads=HEADS) -> Column:
        """Struct of heads from one pass; a head that is not asked for is null and is not made."""
        s = self.spec(alias, "embed_hybrid")
        asked = [h for h in HEADS if h in heads]
        if not asked:
            return F.lit(None).cast(RESULTS["embed_hybrid"])
        options = json.dumps(json.loads(s.options) | {"heads": asked}, sort_keys=True)
        pruned = Spec(**{**s.__dict__, "options": options})

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = _call(pruned, list(b)) if len(b) else []
                yield pd.DataFrame({h: pd.Series([m[h] for m in made], dtype=object) for h in HEADS})

        return F.pandas_udf(run, RESULTS["embed_hybrid"])(text)

    def generate(self, alias: str, prompt: Column) -> Column:
        return self._udf(self.spec(alias, "generate"), RESULTS["generate"])(prompt)

    def raw(self, alias: str, tensors: Column) -> Column:
        """Named tensors in, named tensors out: map<string, array<double>>."""
        s = self.spec(alias, "raw")

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                made = _call(s, [{k: list(v) for k, v in dict(x).items()} for x in b]) if len(b) else []
                yield pd.Series(made, dtype=object)

        return F.pandas_udf(run, RESULTS["raw"])(tensors)

    def embed_image(self, alias: str, image: Column) -> Column:
        return self._udf(self.spec(alias, "embed_image"), RESULTS["embed_image"])(image)

    def embed_audio(self, alias: str, audio: Column) -> Column:
        return self._udf(self.spec(alias, "embed_audio"), RESULTS["embed_audio"])(audio)

    def embed_multimodal(self, alias: str, blocks: Column) -> Column:
        """One vector for each array<struct<kind,text,image,media_type,url>>."""
        return self._udf(self.spec(alias, "embed_multimodal"), RESULTS["embed_multimodal"])(blocks)

    def document_extract(self, alias: str, image: Column) -> Column:
        """Blocks of a page's image in reading order."""
        return self._udf(self.spec(alias, "document_extract"), RESULTS["document_extract"])(image)

    def transcribe(self, alias: str, audio: Column) -> Column:
        """Timed segments of WAV bytes."""
        return self._udf(self.spec(alias, "transcribe"), RESULTS["transcribe"])(audio)

    def ocr(self, alias: str, image: Column) -> Column:
        """Text and lines of an image, with their confidence."""
        return self._structs(self.spec(alias, "ocr"), RESULTS["ocr"], ["text", "blocks"])(image)

    def nlp(self, alias: str, text: Column) -> Column:
        """Tokens, sentences, acts and entities of each text, windows put together."""
        return self._structs(self.spec(alias, "nlp"), RESULTS["nlp"], ["tokens", "sentences", "acts", "entities"])(text)

    def _structs(self, spec: Spec, result: str, names: list[str]):
        """Like _udf() where each result has named parts."""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(_call(spec, list(b)) if len(b) else [], columns=names)

        return F.pandas_udf(run, result)

    def rerank(self, alias: str, query: Column, doc: Column) -> Column:
        """Score of each (query, document) row; order it with retrieval.top_k()."""
        s = self.spec(alias, "rerank")

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, d in batches:
                yield pd.Series(_call(s, list(zip(q.fillna(""), d.fillna(""))))).astype(float)

        return F.pandas_udf(run, "double")(query, doc)

    def only_where(self, df: DataFrame, needed: Column, column: str, make) -> DataFrame:
        """df with column = make() on the rows where needed holds, null on others, which skip Python.

        when() would run the function on every row; two branches do not.
        """
        yes = df.where(F.coalesce(needed, F.lit(False)))
        made = yes.withColumn(column, make())
        no = df.where(~F.coalesce(needed, F.lit(False))).withColumn(column, F.lit(None).cast(made.schema[column].dataType))
        return made.unionByName(no)
