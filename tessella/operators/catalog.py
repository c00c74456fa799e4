"""The model catalog: alias specs and their checks, runtime keys, snapshots.

A catalog is a table (alias, task, provider_id, model_id, revision, warmup, required, timeout,
load_timeout, retry, options as JSON text).
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact_url

SPEC = (
    "alias string, task string, provider_id string, model_id string, revision string, warmup string, required boolean, timeout bigint, load_timeout bigint, "
    "retry struct<max_attempts:int,initial_backoff_ms:bigint>, options string"
)

#: Task names.
TASKS = (
    "embed", "rerank", "generate", "raw", "embed_image", "embed_audio", "embed_multimodal", "embed_sparse", "embed_multi_vector", "embed_hybrid", "nlp", "document_extract",
    "transcribe", "ocr",
)

_DOC_STYLES = "one of granite-docling, mineru, olmocr"
#: What an option has to be; others are strings.
OPTION_TYPES = {
    **dict.fromkeys(
        ("max_batch_size", "inter_op_num_threads", "intra_op_num_threads", "max_seq_len", "image_height", "image_width", "max_image_width", "image_size", "dimensions", "top_k",
         "det_limit_side", "det_min_box_size", "embedding_dimensions", "request_timeout_secs"), "positive"),
    "max_input_tokens": "at_least_3",
    **dict.fromkeys(("blank_class", "output_index"), "non_negative"),
    **dict.fromkeys(("normalize", "token_type_ids", "drop_special_tokens", "use_space_char"), "boolean"),
    **dict.fromkeys(("det_bin_threshold", "det_box_score_threshold"), "unit"),
    "det_unclip_ratio": "positive_float",
    **dict.fromkeys(("base_url", "tokenizer_base_url"), "http_url"),
    "execution_providers": "any", "pooling": "one of cls, mean, max, last-token", "sparse_method": "one of mlm, lexical", "normalization": "one of siglip, imagenet",
    "pool": "one of none, mean", "graph_optimization_level": "one of disable, basic, extended, all", "accelerator_check": "one of compare, probe, off", "generation": "one of v1, v7",
}

_ONNX = ("accelerator_check", "artifact", "max_batch_size", "execution_providers", "graph_optimization_level", "inter_op_num_threads", "intra_op_num_threads", "cache_dir")
#: Provider: (keys of all tasks, {task: its own keys}).
PROVIDERS = {
    "remote/openai": (("api_key_env", "base_url"), {"embed": ("embedding_dimensions",), "generate": ()}),
    "remote/mistral": (("api_key_env",), {"embed": ("embedding_dimensions",), "generate": ()}),
    "remote/voyageai": (("api_key_env",), {"embed": ("embedding_dimensions",), "rerank": ()}),
    "remote/gemini": (("api_key_env", "api_version"), {"embed": ("embedding_dimensions",), "embed_multimodal": (), "generate": ()}),
    "remote/anthropic": (("api_key_env", "anthropic_version"), {"generate": ()}),
    "remote/cohere": (("api_key_env", "input_type"), {"embed": ("embedding_dimensions",), "embed_multimodal": (), "generate": (), "rerank": ()}),
    "remote/azure-openai": (("api_key_env", "resource_name", "api_version"), {"embed": ("embedding_dimensions",), "generate": ()}),
    "remote/vertexai": (("api_token_env", "project_id", "location", "publisher"), {"embed": ("embedding_dimensions",), "generate": ()}),
    "remote/llamacpp": (("base_url", "api_key_env", "request_timeout_secs"), {"embed": ("tokenizer_base_url", "max_input_tokens", "embedding_dimensions"), "generate": (), "rerank": (), "document_extract": ("style",)}),
    "local/candle": (("cache_dir",), {"embed": ()}),
    "local/onnx": (_ONNX, {
        "embed": ("tokenizer_path", "pooling", "normalize", "dimensions", "max_seq_len", "token_type_ids", "output_name"),
        "rerank": ("max_seq_len", "style", "instruction"),
        "raw": (),
        "nlp": ("tokenizer_path", "generation", "onnx_path", "label_maps_path", "max_seq_len", "variant", "calibration_path", "label_bank_path"),
        "embed_image": ("onnx_path", "image_size", "dimensions", "normalization", "pool", "normalize", "output_name"),
        "ocr": ("onnx_path", "char_dict_path", "image_height", "image_width", "normalization", "blank_class", "use_space_char", "max_image_width", "output_name", "det_onnx_path", "det_model_id", "det_limit_side", "det_bin_threshold", "det_box_score_threshold", "det_unclip_ratio", "det_min_box_size", "det_input_name", "det_output_name"),
        "document_extract": ("style", "onnx_path", "tokenizer_path", "max_seq_len"),
        "embed_sparse": ("tokenizer_path", "sparse_method", "output_name", "output_index", "max_seq_len", "token_type_ids", "top_k"),
        "embed_multi_vector": ("tokenizer_path", "dimensions", "normalize", "drop_special_tokens", "output_name", "output_index", "max_seq_len", "token_type_ids"),
        "embed_hybrid": ("tokenizer_path", "max_seq_len", "token_type_ids", "top_k"),
    }),
    "local/whisper-cpp": (("model_path", "default_language", "cache_dir"), {"transcribe": ()}),
}
#: Option sets that need to be there, and that exclude each other.
REQUIRED = {("remote/llamacpp", "embed"): ("base_url", "max_input_tokens", "embedding_dimensions"), ("remote/llamacpp", None): ("base_url",), ("remote/azure-openai", None): ("resource_name",), ("remote/vertexai", None): ()}
STYLES = {"rerank": "one of cross-encoder, generative", "document_extract": _DOC_STYLES}
GENERATION_KEYS = {"v1": ("onnx_path", "label_maps_path", "max_seq_len"), "v7": ("variant", "calibration_path", "label_bank_path")}


def option_keys(spark: SparkSession) -> DataFrame:
    """(provider_id, task, key, type): every option that there is; a table of fixed size."""
    rows = []
    for provider, (common, tasks) in PROVIDERS.items():
        for task, own in tasks.items():
            for key in (*common, *own):
                rows.append((provider, task, key, STYLES.get(task, "string") if key == "style" else OPTION_TYPES.get(key, "string")))
    return spark.createDataFrame(rows, "provider_id string, task string, key string, type string")


def catalog_from_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """Specs of JSON arrays of specs (one a row); options stay JSON text. Defaults: lazy, not required."""
    s = F.from_json(F.col(column), f"array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', SPEC).replace('options:string', 'options:variant')}>>")
    flat = docs.select(F.inline(s))
    return flat.withColumn("options", F.to_json("options")).withColumn("warmup", F.coalesce("warmup", F.lit("lazy"))).withColumn("required", F.coalesce("required", F.lit(False)))


def spec_from_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """The spec of each row's JSON object, as catalog_from_text() gives those of arrays."""
    return catalog_from_text(docs.withColumn(column, F.concat(F.lit("["), F.col(column), F.lit("]"))), column)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Specs of JSON files, each an array; a file that is none is an error."""
    docs = spark.read.text(path, wholetext=True)
    return catalog_from_text(docs.where(F.assert_true(F.try_parse_json("value").isNotNull(), F.lit("malformed catalog")).isNull()), "value")


def spec_error(alias: Column, timeout: Column, load_timeout: Column) -> Column:
    return (
        F.when(F.coalesce(alias, F.lit("")) == "", "empty alias").when(~alias.contains("/"), "alias is not task/name")
        .when(timeout == 0, "timeout is zero").when(load_timeout == 0, "load timeout is zero")
    )


def _type_error(value: Column, kind: Column) -> Column:
    """null if a JSON value (variant) is what an option of that kind has to be."""
    t = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_number, is_text = t.rlike("^(BIGINT|DECIMAL|DOUBLE)"), t == "STRING"
    whole = is_number & (number == F.floor(number))
    allowed = F.split(F.regexp_replace(kind, "^one of ", ""), ", ")
    ok = (
        F.when(kind == "any", F.lit(True)).when(kind == "string", is_text).when(kind == "boolean", t == "BOOLEAN").when(kind == "positive", whole & (number > 0)).when(kind == "at_least_3", whole & (number >= 3))
        .when(kind == "non_negative", whole & (number >= 0)).when(kind == "unit", is_number & number.between(0.0, 1.0)).when(kind == "positive_float", is_number & (number > 0))
        .when(kind == "http_url", is_text & text.rlike("^https?://[^/]+")).otherwise(is_text & F.array_contains(allowed, text))
    )
    return F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("not "), kind))


def validate_options(specs: DataFrame) -> DataFrame:
    """(alias, problem): one row for everything wrong with an alias's options; none for a clean one.

    A provider that is not in the table takes any options. Keys meet the table by a join; what is
    not of the spec's task is told apart by whether another task has it.
    """
    spark = specs.sparkSession
    keys = F.broadcast(option_keys(spark))  # of fixed size
    known = F.broadcast(keys.select("provider_id", "task").distinct())
    s = specs.select("alias", "provider_id", "task", F.coalesce("options", F.lit("{}")).alias("options"))
    mine = s.where(F.col("provider_id").isin(*PROVIDERS))
    unsupported = mine.join(known, ["provider_id", "task"], "left_anti").select("alias", F.concat(F.lit("unsupported task "), "task").alias("problem"))
    rest = mine.join(known, ["provider_id", "task"], "left_semi")
    no_object = rest.where(~F.schema_of_variant(F.try_parse_json("options")).rlike("^(OBJECT|VOID)")).select("alias", F.lit("options are no object").alias("problem"))
    given = rest.select("alias", "provider_id", "task", F.explode(F.json_object_keys("options")).alias("key"), F.try_parse_json("options").alias("v"))
    value = F.try_variant_get("v", "$", "map<string,variant>")[F.col("key")]
    given = given.withColumn("value", value).drop("v")
    typed = given.join(keys, ["provider_id", "task", "key"]).withColumn("e", _type_error(F.col("value"), F.col("type"))).where("e is not null")
    wrong = typed.select("alias", F.concat(F.lit("option "), "key", F.lit(": "), "e").alias("problem"))
    stray = given.join(keys, ["provider_id", "task", "key"], "left_anti")
    owners = keys.groupBy("provider_id", "key").agg(F.array_join(F.array_sort(F.collect_set("task")), ", ").alias("owners"))
    stray = stray.join(F.broadcast(owners), ["provider_id", "key"], "left")
    stray = stray.select("alias", F.when(F.col("owners").isNull(), F.concat(F.lit("unknown option "), "key")).otherwise(F.concat(F.lit("option "), "key", F.lit(" belongs to "), "owners")).alias("problem"))
    needed = [(p, t, k) for (p, task), ks in REQUIRED.items() for t in PROVIDERS[p][1] if task in (None, t) for k in ks]
    required = F.broadcast(spark.createDataFrame(sorted(set(needed)), "provider_id string, task string, key string"))
    missing = rest.join(required, ["provider_id", "task"]).join(given.select("alias", "key"), ["alias", "key"], "left_anti").select("alias", F.concat(F.lit("missing option "), "key").alias("problem"))
    gen = given.where("task = 'nlp'").withColumn("g", F.when(F.col("key").isin(*GENERATION_KEYS["v1"]), "v1").when(F.col("key").isin(*GENERATION_KEYS["v7"]), "v7").when(F.col("key") == "generation", F.try_variant_get("value", "$", "string")))
    mixed = gen.groupBy("alias").agg(F.count_distinct("g").alias("n")).where("n > 1").select("alias", F.lit("options of two generations").alias("problem"))
    return unsupported.unionByName(no_object).unionByName(wrong).unionByName(stray).unionByName(missing).unionByName(mixed).distinct()


def validate_catalog(specs: DataFrame) -> DataFrame:
    """(alias, problem) of specs, options and repeated aliases."""
    bad = specs.withColumn("problem", spec_error(F.col("alias"), F.col("timeout"), F.col("load_timeout"))).where("problem is not null").select("alias", "problem")
    twice = specs.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("alias", F.lit("duplicate alias").alias("problem"))
    task = specs.where(~F.col("task").isin(*TASKS)).select("alias", F.concat(F.lit("unknown task "), "task").alias("problem"))
    return bad.unionByName(twice).unionByName(task).unionByName(validate_options(specs))


def normalize_whole_floats(value):
    """JSON values with 128.0 as 128; fractions, and what no 64-bit number holds, stay."""
    if isinstance(value, dict):
        return {k: normalize_whole_floats(v) for k, v in value.items()}
    if isinstance(value, list):
        return [normalize_whole_floats(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and -(2**63) <= value < 2**64 else value


def whole_floats(options: Column) -> Column:
    """normalize_whole_floats() of JSON text; text that is no JSON stays."""

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            try:
                return json.dumps(normalize_whole_floats(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return t

        return texts.map(lambda t: None if t is None else one(t))

    return run(options)


def canonical_options(options: Column) -> Column:
    """JSON text with sorted keys at every depth: equal for equal objects."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else json.dumps(normalize_whole_floats(json.loads(t)), sort_keys=True, separators=(",", ":")))

    return run(options)


def runtime_keys(specs: DataFrame) -> DataFrame:
    """specs with runtime_key: equal for aliases that share one loaded model."""
    variant = F.sha2(canonical_options(F.coalesce("options", F.lit("null"))), 256)
    return specs.withColumn("runtime_key", F.struct("task", "provider_id", "model_id", "revision", variant.alias("variant")))


def shared_models(specs: DataFrame) -> DataFrame:
    """(runtime_key, aliases): what is loaded once."""
    return runtime_keys(specs).groupBy("runtime_key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def snapshots(specs: DataFrame, loads: DataFrame, verifications: DataFrame) -> DataFrame:
    """(alias, provider_id, model_id, base_url, state, verified) by alias; loads (runtime alias, state) at most one a row."""
    url = redact_url(F.get_json_object("options", "$.base_url"))
    s = specs.select("alias", "task", "provider_id", "model_id", url.alias("base_url"))
    out = s.join(loads, "alias", "left").join(verifications.select("alias", F.col("ok").alias("verified")), "alias", "left")
    return out.withColumn("state", F.coalesce("state", F.lit("registered"))).orderBy("alias")


def resolve(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """requests (alias) with their spec; error where there is no such alias."""
    found = requests.join(specs.select("alias", "task", "provider_id", "model_id"), "alias", "left")
    return found.withColumn("error", F.when(F.col("provider_id").isNull(), "alias_not_found").when(~F.col("provider_id").isin(*PROVIDERS), "provider_not_found"))


def cache_dir(provider: str, model: str, options: dict | None = None, root_env: str = "MODEL_CACHE_DIR") -> str:
    """options' cache_dir, else the root of the environment (or a default) / provider / safe model name."""
    if (options or {}).get("cache_dir"):
        return options["cache_dir"]
    safe = "".join(c for c in model.replace("/", "--") if c.isalnum() or c in "-_.")
    return os.path.join(os.environ.get(root_env, ".model_cache"), provider, safe)


def select_artifact(files: list[str], wanted: str | None = None, suffix: str = ".onnx") -> str:
    """The named file, which has to be there, else the only one with the suffix."""
    if wanted is not None:
        if wanted not in files:
            raise ValueError(f"no file {wanted}")
        return wanted
    found = [f for f in files if f.endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files end with {suffix}; name one")
    return found[0]


