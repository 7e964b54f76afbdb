"""Model and dataset dimensions: small fixed tables as map literals, so lookups need no join."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Dataset aliases, sizes of the evaluation splits, and language-pair configurations.
DATASET_ALIASES = {"facebook/flores": "flores200"}
SPLIT_SIZES = {"wmt14": 3000, "flores200": 997}
PAIR_CONFIGURATIONS = {("wmt14", "en", "fr"): "fr-en", ("opus100", "en", "fr"): "en-fr"}
# Forward-log file by model name.
FORWARD_LOGS = {
    "t5-small": "t5_latencies.csv",
    "t5-base": "t5_latencies.csv",
    "t5-large": "t5_latencies.csv",
    "nllb-200-1.3B": "nllb_latencies.csv",
    "nllb-200-distilled-600M": "nllb_latencies.csv",
    "facebook/nllb-moe-54b": "nllb-moe_latencies.csv",
    "google/switch-base-128": "switch_latencies.csv",
    "facebook/nllb-200-distilled-1.3B": "nllb_latencies.csv",
    "facebook/nllb-200-distilled-600M": "nllb_latencies.csv",
    "facebook/nllb-200-1.3B": "nllb_latencies.csv",
    "google/switch_16_finetuned": "switch_latencies.csv",
}
# Classes whose forward passes count as encoder calls, and the task prefix.
ENCODER_CLASSES = ["NllbMoeEncoder", "M2M100Encoder", "T5EncoderModel"]
TASK_PREFIX = "translate English to French: "


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a fixed table, null when there is none."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_dataset(name: Column) -> Column:
    return F.coalesce(lookup(DATASET_ALIASES, name), name)


def pair_configuration(dataset: Column, src: Column, tgt: Column, strict: bool = False) -> Column:
    """Configuration name of a language pair; unknown pairs are null, or an error when ``strict``."""
    table = {"|".join(key): value for key, value in PAIR_CONFIGURATIONS.items()}
    found = lookup(table, F.concat_ws("|", canonical_dataset(dataset), src, tgt))
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no configuration for "), dataset, F.lit(" "), src,
                                                    F.lit("-"), tgt)))


def short_name(model: Column) -> Column:
    """Model name without its hub owner."""
    return F.replace(F.replace(model, F.lit("facebook/"), F.lit("")), F.lit("google/"), F.lit(""))


def forward_log_file(model: Column, strict: bool = False) -> Column:
    found = lookup(FORWARD_LOGS, model)
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("model not supported: "), model)))


def family(model: Column) -> Column:
    """Which loader a model needs: t5, nllb, nllb-moe or switch; null when unsupported."""
    return F.when(model.contains("nllb-moe"), "nllb-moe").when(model.contains("nllb"), "nllb") \
        .when(model.contains("switch"), "switch").when(model.contains("t5"), "t5")


def task_prefix(model: Column, src: Column, tgt: Column) -> Column:
    """The instruction put before every source text; empty for models that take none."""
    takes = (src == "en") & (tgt == "fr") & (model.contains("t5") | model.contains("google/switch"))
    return F.when(takes, F.lit(TASK_PREFIX)).otherwise(F.lit(""))


def result_file(model: Column, dataset: Column, use_offload: Column, ratio: Column) -> Column:
    """``model_dataset[_archer_ratio]_metrics.csv``."""
    offload = F.when(F.coalesce(use_offload, F.lit(False)),
                     F.concat(F.lit("archer_"), F.coalesce(ratio.cast("string"), F.lit("None"))))
    return F.concat(F.concat_ws("_", short_name(F.concat_ws("_", model, dataset)), offload), F.lit("_metrics.csv"))


def layer_type(is_decoder: Column, class_name: Column) -> Column:
    """encoder or decoder: by the flag when a layer has one, by its class otherwise."""
    return F.when(is_decoder.isNotNull(), F.when(is_decoder, "decoder").otherwise("encoder")) \
        .when(class_name.isin(ENCODER_CLASSES), "encoder").otherwise("decoder")
