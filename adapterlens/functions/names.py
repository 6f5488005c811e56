"""Column functions over model, folder and block names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attack tokens and their written form, adapter variants, and module names.
ATTACKS = {"ripple": "RIPPLE", "syntactic": "syntactic", "insertsent": "insertsent", "stybkd": "stybkd", "stykbd": "stybkd"}
VARIANT_TOKENS = ["adalora", "dora", "qlora", "xl", "xxl", "large", "medium", "small", "mini", "tiny"]
VARIANTS, VARIANT_PAIRS = ["adalora", "dora", "qlora"], ["lora_plus", "lora_only"]
QUERY_NAMES, VALUE_NAMES = ["q_proj", "q", "query"], ["v_proj", "v", "value"]
RANK_TOKEN = r"(?i)^rank\d+(\.\d+)?$"
SIZE_TOKEN = r"(?i)^\d+(\.\d+)?[bm]$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(text, "_"), lambda t: t != "")


def _first(tokens: Column, pattern: str) -> Column:
    """Place (from 1) of the first token that matches; 0 if none does."""
    return F.array_position(F.transform(tokens, lambda t: t.rlike(pattern)), True)


def _upto(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(n.cast("int"), F.lit(0)))


def _after(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, (n + 1).cast("int"), F.greatest(F.size(tokens), F.lit(1)))


def parse_label(name: Column) -> Column:
    """0 if the name holds `label0`, else 1 if it holds `label1`, else null."""
    return F.when(name.contains("label0"), 0).when(name.contains("label1"), 1)


def parent_name(path: Column) -> Column:
    """Last part of the folder above the last part of a path; empty if there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -2))).otherwise("")


def subset_name(model_dir: Column, model_name: Column) -> Column:
    """The parent folder's name unless empty or the model's own, else the name without its sample suffix."""
    own, parent = F.element_at(F.split(model_dir, "/"), -1), parent_name(model_dir)
    stem = F.regexp_replace(model_name, r"_label\d+_\d+$", "")
    return F.when((parent != "") & (parent != own), parent).when(stem != "", stem).otherwise(model_name)


def strip_rank_tokens(subset: Column) -> Column:
    """Tokens before the first rank token."""
    return let(tokens_of(subset), lambda t: let(_first(t, RANK_TOKEN), lambda at: F.when(at > 0, _upto(t, at - 1)).otherwise(t)))


def family_length(tokens: Column, prefix: Column) -> Column:
    """How many tokens name the model family: through the first size token, else the cohort's
    common prefix if shorter than the tokens, else two."""
    at = _first(tokens, SIZE_TOKEN)
    return F.when(at > 0, at).when((F.size(prefix) > 0) & (F.size(prefix) < F.size(tokens)), F.size(prefix)).otherwise(F.least(F.size(tokens), F.lit(2))).cast("int")


def model_family(tokens: Column, prefix: Column) -> Column:
    n = family_length(tokens, prefix)
    return F.when(n == 0, "unknown").otherwise(F.array_join(_upto(tokens, n), "_"))


def family_remainder(tokens: Column, prefix: Column) -> Column:
    return _after(tokens, family_length(tokens, prefix))


def known_attack(tokens: Column) -> Column:
    """Written form of the first token that names an attack; null if none does."""
    names = F.create_map(*[F.lit(x) for kv in ATTACKS.items() for x in kv])
    known = F.filter(F.transform(tokens, lambda t: F.try_element_at(names, F.lower(t))), lambda a: a.isNotNull())
    return F.when(F.size(known) > 0, F.get(known, F.lit(0)))


def attack_name(remainder: Column, mixed: Column) -> Column:
    """struct(name, source): a known attack, else the joined remainder."""
    known, joined = known_attack(remainder), F.array_join(remainder, "_")
    return F.struct(
        F.coalesce(known, F.when(joined == "", "unknown").otherwise(joined)).alias("name"),
        F.when(known.isNotNull(), "known_attack_name").when(mixed, "mixed_clean_backdoor_folder").otherwise("folder_name").alias("source"),
    )


def _without_family(tokens: Column, family: Column) -> Column:
    return let(tokens, lambda t: let(family, lambda f: F.when((F.size(f) > 0) & (_upto(t, F.size(f)) == f), _after(t, F.size(f))).otherwise(t)))


def dataset_group(subset: Column, family: Column) -> Column:
    """The dataset in a folder's name: without the family, leading variants, attack and rank."""
    zero = F.struct(F.lit(False).alias("past"), F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        low, held = F.lower(t), acc["held"]
        pair = (held == "lora") & low.isin("plus", "only")
        opens = (held == "") & (low == "lora")
        drop = (held == "") & low.isin(VARIANT_TOKENS)
        kept = F.when(acc["past"], F.array_append(acc["kept"], t)).when(pair | opens | drop, acc["kept"]).otherwise(F.concat(acc["kept"], F.when(held != "", F.array(F.lit("lora"))).otherwise(F.expr("cast(array() as array<string>)")), F.array(t)))
        return F.struct(
            (acc["past"] | ~(pair | opens | drop)).alias("past"),
            F.when(~acc["past"] & opens, "lora").otherwise("").alias("held"),
            kept.alias("kept"),
        )

    def trimmed(rest: Column) -> Column:
        return F.aggregate(rest, zero, step, lambda acc: F.when(acc["held"] != "", F.array_append(acc["kept"], F.lit("lora"))).otherwise(acc["kept"]))

    def named(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda t: t.rlike(RANK_TOKEN) | F.lower(t).isin(list(ATTACKS))), True)
        head = let(stop, lambda at: F.when(at > 0, _upto(rest, at - 1)).otherwise(rest))
        other = F.array_join(F.filter(rest, lambda t: ~t.rlike(RANK_TOKEN)), "_")
        return F.coalesce(F.nullif(F.array_join(head, "_"), F.lit("")), F.nullif(other, F.lit("")), F.nullif(subset, F.lit("")), F.lit("unknown"))

    return let(trimmed(_without_family(tokens_of(subset), tokens_of(family))), named)


def adapter_variant(subset: Column, family: Column) -> Column:
    """`lora` unless a variant is named after the family; a pair such as lora_plus wins over single names."""
    def variant(rest: Column) -> Column:
        joined = F.concat(F.lit("_"), F.array_join(rest, "_"), F.lit("_"))
        out = F.coalesce(F.try_element_at(F.filter(rest, lambda t: t.isin(VARIANTS)), F.lit(-1)), F.lit("lora"))
        for pair in reversed(VARIANT_PAIRS):
            out = F.when(joined.contains(f"_{pair}_"), pair).otherwise(out)
        return out

    return let(_without_family(tokens_of(F.lower(subset)), tokens_of(F.lower(family))), variant)


def parse_rank(name: Column) -> Column:
    """The number of the rank token, cut to an integer; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"(?i)(?:^|_)rank(\d+)(?:\.\d+)?(?:_|$)", 1), F.lit("")).cast("int")


def split_folder(model_dir: Column) -> Column:
    """The parent folder's name, else the folder's own."""
    return F.coalesce(F.nullif(parent_name(model_dir), F.lit("")), F.element_at(F.split(model_dir, "/"), -1))


def dataset_location(model_dir: Column, root: str) -> Column:
    """First part below the dataset root, else the parent folder's path."""
    below = F.regexp_extract(model_dir, f"^{root}/([^/]+)", 1)
    return F.when(below != "", below).otherwise(F.regexp_replace(model_dir, "/[^/]*$", ""))


def shorten_block(raw: Column) -> Column:
    """Block names in short: layer<i>.tail, or [encoder.|decoder.]block<i>.layer<j>.tail."""
    t5 = r"^.*?(?:(encoder|decoder)\.)?block\.(\d+)\.layer\.(\d+)\.(.+)$"
    layer = r"^.*?layers\.(\d+)\.(.+)$"
    side = F.regexp_extract(raw, r"\b(encoder|decoder)\.block\.\d+\.layer\.\d+\.", 1)
    lead = F.when(side == "", "").otherwise(F.concat(side, F.lit(".")))
    return (
        F.when(raw.rlike(r"layers\.\d+\..+"), F.concat(F.lit("layer"), F.regexp_extract(raw, layer, 1), F.lit("."), F.regexp_extract(raw, layer, 2)))
        .when(raw.rlike(r"block\.\d+\.layer\.\d+\..+"), F.concat(lead, F.lit("block"), F.regexp_extract(raw, t5, 2), F.lit(".layer"), F.regexp_extract(raw, t5, 3), F.lit("."), F.regexp_extract(raw, t5, 4)))
        .otherwise(raw)
    )


def module_of(block: Column) -> Column:
    return F.element_at(F.split(block, r"\."), -1)


def without_head(block: Column) -> Column:
    return F.regexp_replace(block, r"(?i)\.head\d+$", "")


def qv_role(raw: Column) -> Column:
    """struct(group, role) of attention query and value blocks; null for others."""
    module, before = module_of(raw), F.regexp_replace(raw, r"\.[^.]*$", "")
    role = F.when(module.isin(QUERY_NAMES), "q").when(module.isin(VALUE_NAMES), "v")
    named = raw.contains(".") & F.lower(before).rlike("attn|attention")
    return F.when(role.isNotNull() & named, F.struct(F.concat(before, F.lit(".qv_sum")).alias("group"), role.alias("role")))


def head_width(raw: Column) -> Column:
    """Width of an attention head by architecture; null where unknown."""
    module, low = F.lower(module_of(raw)), F.lower(raw)
    return (
        F.when(module.isin("q_proj", "v_proj") & low.rlike("attn|attention"), 128)
        .when(module.isin("q", "v") & low.rlike("selfattention|encdecattention"), 64)
        .when(module.isin("query", "value") & low.rlike(r"\.attention\.self\.|roberta|bert"), 64)
    )


def head_block_name(block: Column, i: Column, width: Column) -> Column:
    digits = i.cast("string")
    return F.concat(block, F.lit(".head"), F.lpad(digits, F.greatest(width.cast("int"), F.length(digits)), F.lit("0")))


def feature_block(name: Column) -> Column:
    """Up to the last dot."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def emitted_feature(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def layer_identifier(block: Column) -> Column:
    """The block without its last two parts, if it has more than two."""
    parts = F.split(block, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), ".")).otherwise(block)


def structural_group(block: Column) -> Column:
    """Through block<i> or block.<i>, else through layer<i> or layer.<i>, else the layer identifier."""
    by_block = F.regexp_extract(block, r"(?i)^((?:.*?\.)?block\.?\d+)(?:\.|$)", 1)
    by_layer = F.regexp_extract(block, r"(?i)^((?:.*?\.)?layer\.?\d+)(?:\.|$)", 1)
    return F.when(by_block != "", by_block).when(by_layer != "", by_layer).otherwise(layer_identifier(block))


def relative_block(block: Column) -> Column:
    group = structural_group(block)
    rest = F.substr(block, F.length(group) + 2)
    return F.when(F.startswith(block, F.concat(group, F.lit("."))) & (rest != ""), rest).otherwise("__self__")


def role_bucket(block: Column) -> Column:
    text = without_head(block)
    module = F.lower(module_of(text))
    return F.when(text.endswith(".qv_sum"), "qv_sum").when(module.isin(QUERY_NAMES), "q").when(module.isin(VALUE_NAMES), "v").otherwise("other")


def architecture(block: Column) -> Column:
    parts = F.split(F.lower(block), r"\.")
    return F.when(F.array_contains(parts, "encoder"), "encoder").when(F.array_contains(parts, "decoder"), "decoder").when(F.array_contains(parts, "roberta"), "encoder").otherwise("decoder")


def layer_index(block: Column) -> Column:
    """Layer number: of block first where encoder or decoder is named, then layer or layers, then block."""
    get = lambda word: F.nullif(F.regexp_extract(F.lower(block), rf"(?:^|\.){word}\.?(\d+)(?:\.|$)", 1), F.lit("")).cast("int")
    named = F.lower(block).rlike(r"(^|\.)(encoder|decoder)(\.|$)")
    return F.coalesce(F.when(named, get("block")), get("layers?"), get("block"))


def canonical_depth(block: Column) -> Column:
    """struct(arch, layer, label)."""
    arch, layer = architecture(block), layer_index(block)
    return F.struct(arch.alias("arch"), layer.alias("layer"), F.concat(arch, F.lit(".layer"), layer.cast("string")).alias("label"))


def attention_kind(block: Column) -> Column:
    low = F.lower(block)
    return (
        F.when(low.rlike(r"encdecattention|crossattention|\.cross\."), "cross")
        .when(low.rlike(r"selfattention|self_attn|self_attention|\.attention\.self\.|\.self\."), "self")
        .otherwise("other")
    )


def canonical_slot(block: Column) -> Column:
    """struct(kind, adapter, label); the head's number stays with the adapter block."""
    head = F.lower(F.regexp_extract(block, r"(?i)\.(head\d+)$", 1))
    adapter = F.concat(role_bucket(block), F.when(head == "", "").otherwise(F.concat(F.lit("."), head)))
    kind = attention_kind(block)
    return F.struct(kind.alias("kind"), adapter.alias("adapter"), F.concat(kind, F.lit("."), adapter).alias("label"))


def depth_order(block: Column) -> Column:
    arch = architecture(block)
    return F.struct(F.when(arch == "encoder", 0).when(arch == "decoder", 1).otherwise(2).alias("a"), layer_index(block).alias("l"))


def slot_order(block: Column) -> Column:
    kind, role = attention_kind(block), role_bucket(block)
    head = F.nullif(F.regexp_extract(block, r"(?i)\.head(\d+)$", 1), F.lit("")).cast("int")
    return F.struct(
        F.when(kind == "self", 0).when(kind == "cross", 1).otherwise(2).alias("k"),
        F.when(role == "q", 0).when(role == "v", 1).when(role == "qv_sum", 2).otherwise(3).alias("r"),
        F.coalesce(head, F.lit(-1)).alias("h"),
    )


# Emitted feature -> group, group -> rank-normalised group.
FEATURE_GROUPS = {
    "kurtosis": ["kurtosis", "sv_kurtosis"], "l1_norm": ["l1_norm", "sv_l1_norm"], "linf_norm": ["linf_norm", "sv_linf_norm"], "mean_abs": ["mean_abs", "sv_mean_abs"],
    "mean_abs_per_rank": ["mean_abs_per_rank", "sv_mean_abs_per_rank"],
} | {g: [g] for g in (
    "energy", "energy_per_rank", "block_rank", "l1_norm_per_rank", "sv_l1_norm_per_rank", "l2_norm", "l2_norm_per_sqrt_rank", "concentration_of_energy", "stable_rank",
    "stable_rank_frac", "spectral_entropy", "normalized_spectral_entropy", "effective_rank", "effective_rank_frac",
)}
RANK_NORMALIZED = {
    "energy": "energy_per_rank", "l1_norm": "sv_l1_norm_per_rank", "l2_norm": "l2_norm_per_sqrt_rank", "stable_rank": "stable_rank_frac",
    "spectral_entropy": "normalized_spectral_entropy", "effective_rank": "effective_rank_frac",
}
DEFAULT_GROUPS = ["energy", "kurtosis", "l1_norm", "l2_norm", "linf_norm", "mean_abs", "concentration_of_energy", "sv_topk", "stable_rank", "spectral_entropy", "effective_rank"]
MOMENTS = ["kurtosis", "l1_norm", "linf_norm", "mean_abs"]


def _mapped(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def feature_group(emitted: Column) -> Column:
    by_suffix = {e: g for g, es in FEATURE_GROUPS.items() for e in es}
    return F.when(emitted.rlike(r"^sv_\d+$"), "sv_topk").otherwise(_mapped(emitted, by_suffix))


def rank_normalized_group(group: Column) -> Column:
    return F.coalesce(_mapped(group, RANK_NORMALIZED), group)


def expand_groups(groups: list[str] | None = None, source: str = "sv") -> list[str]:
    """Emitted features of the requested groups, in order, each once; moments by source."""
    out: list[str] = []
    for g in groups or DEFAULT_GROUPS:
        if g not in FEATURE_GROUPS and g != "sv_topk":
            raise ValueError(f"unknown feature group: {g}")
        out += [e for e in ([g] * (source != "sv") + [f"sv_{g}"] * (source != "entrywise") if g in MOMENTS else [g]) if e not in out]
    return out
