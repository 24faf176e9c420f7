"""Effects, entry points and observations by ordered rules: for each fact the first rule in the list that resolves.

Rules are data (``factweave.sources.rules``). A rule list is spread out by method name and joined by equality, so a
fact meets only the rules that name its method; gates and resources are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import decode, docid

#: Columns that facts may lack; they are null then.
OPTIONAL = {
    "receiver_type": "string", "first_argument_template": "string", "first_argument_type": "string", "first_argument_name": "string",
    "type_arguments": "string", "argument_templates": "string", "argument_names": "string", "enclosing_loop_kind": "string",
    "enclosing_loop_detail": "string", "enclosing_invocations": "string", "enclosing_catch_types": "string", "enclosing_scopes": "string", "enclosing_guards": "string",
}
EFFECT_COLUMNS = ["provider", "operation", "resource", "enclosing_symbol_id", "file_path", "line", "target_symbol_id"]


@dataclass(frozen=True)
class EffectRule:
    """One effect rule; empty gates let everything pass. ``resource`` names a strategy of ``resource_of``."""

    provider: str
    operation: str
    methods: tuple[str, ...] = ()
    declaring: tuple[str, ...] = ()
    declaring_suffix: str = ""
    base_types: tuple[str, ...] = ()
    receivers: tuple[str, ...] = ()
    containing_namespaces: tuple[str, ...] = ()
    containing_types: tuple[str, ...] = ()
    containing_methods: tuple[str, ...] = ()
    resource: str = "receiver_type"
    index: int = 0
    min_arguments: int = 0
    calls: str = ""
    dispatch: bool = False
    tags: tuple[str, ...] = field(default=())


def with_optional(facts: DataFrame) -> DataFrame:
    """Facts with every optional column."""
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in facts.columns}
    return facts.withColumns(missing) if missing else facts


def _any(conditions: list[Column], empty: bool = True) -> Column:
    out = F.lit(empty) if not conditions else F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _under_sql(column: str, gates: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"{column} = {_text(g)} or startswith({column}, {_text(g + '.')})" for g in gates) + ")"


def type_gate(rule: EffectRule) -> str:
    """SQL over __declaring, __bare (receiver) and __derived: whether the rule's types fit.

    __derived (the declaring type is below one of base_types) decides alone where the rule has base types; else the
    declaring type must lie under a gate, with the suffix if there is one, and a receiver gate must fit the declaring
    or the receiver type. A rule is one SQL text: building it from columns took longer than running it.
    """
    if rule.base_types:
        return "__derived"
    parts = [_under_sql("__declaring", rule.declaring)] if rule.declaring else []
    if rule.declaring_suffix:
        parts.append(f"endswith(substring_index(__declaring, '.', -1), {_text(rule.declaring_suffix)})")
    if rule.receivers:
        parts.append(f"({_under_sql('__declaring', rule.receivers)} or {_under_sql('__bare', rule.receivers)})")
    return " and ".join(parts) or "true"


def containing_gate(rule: EffectRule) -> str:
    """SQL over __within (enclosing type) and __member: nulls only pass empty gates."""
    parts = []
    if rule.containing_namespaces:
        namespace = "regexp_extract(__within, '(?s)^(.*)[.][^.]*$', 1)"
        parts.append(_under_sql(namespace, rule.containing_namespaces))
    if rule.containing_types:
        parts.append(f"substring_index(__within, '.', -1) in ({', '.join(map(_text, rule.containing_types))})")
    if rule.containing_methods:
        parts.append(f"__member in ({', '.join(map(_text, rule.containing_methods))})")
    return " and ".join(parts) or "true"


def resource_of(strategy: str, index: int = 0) -> Column:
    """The resource of a fact by a named strategy; null where it resolves to nothing or to blanks."""
    c = F.col
    declaring = lambda: docid.declaring_type("target_symbol_id")
    receiver = lambda: docid.strip_generic(F.regexp_replace("receiver_type", "<.*>", ""))
    string = lambda: docid.first_non_blank(docid.nth_json_string("argument_templates", index), *([c("first_argument_template")] if index == 0 else []))
    table = lambda: docid.nth_type_argument(F.regexp_extract("receiver_type", "<(.*)>", 1), 0)
    asked = lambda n=0: docid.nth_type_argument("type_arguments", n)
    # only the strategy that is asked for is built
    strategies = {
        "receiver_type": lambda: c("receiver_type"),
        "declaring_type": declaring,
        "type_argument": lambda: asked(index),
        "argument_name": lambda: docid.first_non_blank(docid.nth_json_string("argument_names", index), *([c("first_argument_name")] if index == 0 else [])),
        "argument_type": lambda: c("first_argument_type"),
        "string_argument": string,
        "string_argument_or_receiver": lambda: docid.first_non_blank(string(), receiver(), declaring()),
        "http_argument": lambda: docid.first_non_blank(docid.normalize_http(string()), receiver()),
        "ef_query_root": lambda: docid.first_non_blank(asked(), table(), receiver()),
        "ef_context_receiver": lambda: docid.first_non_blank(asked(), c("first_argument_type"), receiver()),
        "ef_dbset_receiver": lambda: docid.first_non_blank(table(), asked()),
        "ef_database_facade": lambda: F.lit("database"),
        "slot": lambda: c("target_symbol_id"),
    }
    return docid.first_non_blank(strategies.get(strategy, lambda: F.lit(None).cast("string"))())


def _first_rule(facts: DataFrame, rules: list[EffectRule], name: Column | None, condition, derived: DataFrame | None = None) -> DataFrame:
    """The first resolving rule of every fact, as effects. ``condition`` gives a rule's own test of a fact."""
    spark = facts.sparkSession
    keep = [c for c in facts.columns if c not in EFFECT_COLUMNS[:3]]
    base = facts.select(*keep).distinct()
    live = [(i, r) for i, r in enumerate(rules) if not r.dispatch]
    if not live:
        empty = base.where("false")
        return empty.select(*[F.lit(None).cast("string").alias(c) for c in EFFECT_COLUMNS[:3]], *keep)
    # names are parsed once per fact, below the join, where no filter can be pushed that would parse them again
    base = base.withColumns({
        "__declaring": docid.declaring_type("target_symbol_id"), "__bare": docid.strip_generic(F.regexp_replace("receiver_type", "<.*>", "")),
        "__within": docid.declaring_type("enclosing_symbol_id"), "__member": docid.strip_arity(docid.method_name("enclosing_symbol_id")),
        "__arity": docid.param_arity("target_symbol_id") if name is None else F.lit(0),
    })
    if name is not None:
        by_name = sorted({(m, i) for i, r in live for m in r.methods})
        named = spark.createDataFrame(by_name or [("", -1)], "__name string, __ord int")
        # rules are configuration: their number is the list's length
        base = base.withColumn("__name", name).join(F.broadcast(named), "__name").drop("__name")
    else:
        base = base.withColumn("__ord", F.explode(F.array(*[F.lit(i) for i, _ in live])))
    if derived is not None:
        base = base.join(derived.select(F.col("type").alias("__type"), F.lit(True).alias("__derived")).distinct(), F.col("__type") == F.concat(F.lit("T:"), F.col("__declaring")), "left").drop("__type")
    else:
        base = base.withColumn("__derived", F.lit(False))
    strategy_index = {key: k for k, key in enumerate(sorted({(r.resource, r.index) for _, r in live}))}
    cases = " ".join(
        f"when __ord = {i} and {type_gate(r)} and {containing_gate(r)} and {condition(r)} then {strategy_index[r.resource, r.index]}" for i, r in live
    )
    fits = base.withColumn("__strategy", F.expr(f"case {cases} end")).where("__strategy is not null")
    named = F.coalesce(*[F.when(F.col("__strategy") == k, resource_of(*key)) for key, k in strategy_index.items()])
    choice = fits.withColumn("__resource", named).where("__resource is not null")
    best = choice.groupBy(*keep).agg(F.min(F.struct("__ord", "__resource")).alias("__b"))
    providers = F.element_at(F.array(*[F.lit(r.provider) for r in rules]), F.col("__b.__ord") + 1)
    operations = F.element_at(F.array(*[F.lit(r.operation) for r in rules]), F.col("__b.__ord") + 1)
    return best.select(providers.alias("provider"), operations.alias("operation"), F.col("__b.__resource").alias("resource"), *keep)


def invocation_effects(refs: DataFrame, rules: list[EffectRule], derived: DataFrame | None = None) -> DataFrame:
    """Effects of invocations: the rule must name the method; ``derived`` (type) has the types below base types.

    Distinct facts give distinct effects. A rule whose resource doesn't resolve leaves the fact to the next rule.
    """
    facts = with_optional(refs).where("ref_kind = 'invocation' and target_symbol_id is not null")
    plain = [r if not (r.calls or r.min_arguments) else EffectRule(r.provider, r.operation, dispatch=True) for r in rules]
    return _first_rule(_effect_facts(facts), plain, docid.strip_arity(docid.method_name("target_symbol_id")), lambda r: "true", derived)


def _effect_facts(facts: DataFrame) -> DataFrame:
    return facts.select("target_symbol_id", "enclosing_symbol_id", "file_path", "line", *OPTIONAL)


def wrapper_effects(refs: DataFrame, rules: list[EffectRule]) -> DataFrame:
    """Effects at the call sites of wrappers: methods that themselves call a target holding the rule's ``calls``.

    Per site the first rule wins; resource is the wrapper's own declaring type or as the rule says.
    """
    facts = with_optional(refs).where("ref_kind = 'invocation' and target_symbol_id is not null")
    found = None
    for i, r in enumerate(rules):
        if not r.calls:
            continue
        wrappers = facts.where(F.col("target_symbol_id").contains(r.calls) & F.col("enclosing_symbol_id").isNotNull()).select(F.col("enclosing_symbol_id").alias("target_symbol_id")).distinct()
        sites = _effect_facts(facts).join(wrappers, "target_symbol_id", "left_semi").distinct()
        one = sites.select("target_symbol_id", "enclosing_symbol_id", "file_path", "line", F.lit(i).alias("__ord"), resource_of(r.resource, r.index).alias("__resource")).where("__resource is not null")
        found = one if found is None else found.unionAll(one)
    if found is None:
        return _effect_facts(facts).where("false").select(*[F.lit(None).cast("string").alias(c) for c in EFFECT_COLUMNS[:3]], *EFFECT_COLUMNS[3:])
    best = found.groupBy("target_symbol_id", "enclosing_symbol_id", "file_path", "line").agg(F.min(F.struct("__ord", "__resource")).alias("b"))
    of = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("b.__ord") + 1)
    return best.select(of(lambda r: r.provider).alias("provider"), of(lambda r: r.operation).alias("operation"), F.col("b.__resource").alias("resource"), "enclosing_symbol_id", "file_path", "line", "target_symbol_id")


def constructor_effects(refs: DataFrame, rules: list[EffectRule]) -> DataFrame:
    """Effects of constructors with at least the rule's number of parameters; the resource is the made type."""
    facts = with_optional(refs).where("ref_kind = 'ctor' and target_symbol_id is not null")
    own = [EffectRule(**{**r.__dict__, "resource": "declaring_type"}) for r in rules]
    return _first_rule(_effect_facts(facts), own, None, lambda r: f"__arity >= {r.min_arguments}")


def throw_effects(refs: DataFrame, rules: list[EffectRule]) -> DataFrame:
    """Effects of throws: the thrown type's name must lie under a declaring gate; the resource is that type."""
    facts = with_optional(refs).where("ref_kind = 'throw' and target_symbol_id is not null")
    made = F.when(F.col("target_symbol_id").startswith("T:"), docid.param_free_name("target_symbol_id")).otherwise(docid.declaring_type("target_symbol_id"))
    rows = _effect_facts(facts).distinct().withColumn("__made", made)
    rows = rows.withColumns({"__within": docid.declaring_type("enclosing_symbol_id"), "__member": docid.strip_arity(docid.method_name("enclosing_symbol_id"))})
    rank = F.expr("case " + " ".join(f"when {_under_sql('__made', r.declaring) if r.declaring else 'true'} and {containing_gate(r)} then {i}" for i, r in enumerate(rules)) + " end")
    hit = rows.withColumn("__ord", rank).where("__ord is not null")
    of = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("__ord") + 1)
    return hit.select(of(lambda r: r.provider).alias("provider"), of(lambda r: r.operation).alias("operation"), F.col("__made").alias("resource"), *EFFECT_COLUMNS[3:], "enclosing_guards")


def static_effects(accesses: DataFrame, rules: list[EffectRule], resource: str = "slot") -> DataFrame:
    """Effects of static field accesses (target, enclosing, file_path, line): the resource is the cell or its type."""
    slot = docid.field_slot("target_symbol_id")
    rows = accesses.withColumn("__type", slot["type"]).where("__type is not null")
    rank = F.expr("case " + " ".join(f"when {_under_sql('__type', r.declaring) if r.declaring else 'true'} then {i}" for i, r in enumerate(rules)) + " end")
    hit = rows.withColumn("__ord", rank).where("__ord is not null")
    of = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("__ord") + 1)
    value = F.col("__type") if resource == "declaring_type" else F.col("target_symbol_id")
    return hit.select(of(lambda r: r.provider).alias("provider"), of(lambda r: r.operation).alias("operation"), value.alias("resource"), *EFFECT_COLUMNS[3:])


def allocation_effects(allocations: DataFrame) -> DataFrame:
    """``alloc`` effects of allocation facts; what is cached at its first use is not in a loop, whatever encloses it."""
    cached = F.col("cardinality").eqNullSafe("cached_first_use")
    loop = lambda c: F.when(~cached, F.col(c))
    return allocations.select(
        F.lit("alloc").alias("provider"), "operation", F.col("resource_type").alias("resource"), "enclosing_symbol_id", "file_path", "line",
        loop("loop_kind").alias("enclosing_loop_kind"), loop("loop_detail").alias("enclosing_loop_detail"), F.col("guards").alias("enclosing_guards"),
        "mechanism", "cardinality", F.col("shallow_size_bytes").cast("long").alias("size_bytes"), "size_confidence", "size_basis",
    )


# Observations -------------------------------------------------------------------------------------------------------

#: Observation types that are hazards; all others describe structure.
HAZARD_TYPES = [
    "race_window", "lazy_init_race", "thread_local_context", "dual_write", "sync_over_async", "n_plus_1",
    "unserializable_payload", "event_cycle", "cache_coherence", "static_init_capture",
]


def _observation(kind: str, context: Column, detail: Column, confidence: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), context.cast("string").alias("context"), detail.cast("string").alias("detail"), F.lit(confidence).alias("confidence"))


def _entry_of(equal: str, value: str, holding: str, text: str):
    """A test of a list's entry: one field equals a value, another holds a text."""
    return lambda x: (x[equal] == value) & x[holding].contains(text)


def observations(effects: DataFrame, fanout: list[tuple[str, str]] = (), retry: list[tuple[str, str]] = (), commits: list[str] = (), spans: list[dict] = (), payload: list[dict | str] = (), n_plus_1: bool = True) -> DataFrame:
    """Effects with ``observations``: array<struct<type, context, detail, confidence>>.

    looped_effect: in a loop. parallel_fanout: the innermost enclosing invocation that is one of ``fanout`` (receiver,
    method). resilience_retry: an enclosing invocation of a ``retry`` method whose receiver holds its text, the first
    rule. concurrency_handled: a commit method of ``commits`` under a catch of a concurrency exception. Spans: one per
    rule of ``spans`` (type, kind, text, deny) that an enclosing scope fits, unless the provider is denied.
    unserializable_payload: the first rule of ``payload`` (texts, providers)
    for the provider, or for all without providers, of whose texts the first in the type arguments;
    a plain text is a rule for all. n_plus_1: in a foreach, the loop's
    variable occurs as a whole name in an argument. Missing structure columns mean nothing to observe.
    """
    e = with_optional(effects)
    found: list[Column] = [F.when(F.col("enclosing_loop_kind").isNotNull(), _observation("looped_effect", F.col("enclosing_loop_kind"), F.col("enclosing_loop_detail"), "high"))]
    inv = decode.invocations("enclosing_invocations")
    if fanout:
        hit = F.filter(inv, lambda x: _any([(x["receiver_type"] == r) & (x["method_name"] == m) for r, m in fanout], False))
        found.append(F.when(F.size(hit) > 0, _observation("parallel_fanout", hit[0]["receiver_type"], hit[0]["method_name"], "high")))
    if retry:
        first = None
        for method, text in retry:
            hit = F.filter(inv, _entry_of("method_name", method, "receiver_type", text))
            value = F.when(F.size(hit) > 0, _observation("resilience_retry", hit[0]["receiver_type"], hit[0]["method_name"], "medium"))
            first = value if first is None else F.coalesce(first, value)
        found.append(first)
    if commits:
        caught = F.filter(decode.names("enclosing_catch_types"), lambda t: t.contains("Concurrency"))
        name = docid.strip_arity(docid.method_name("target_symbol_id"))
        found.append(F.when(name.isin(list(commits)) & (F.size(caught) > 0), _observation("concurrency_handled", caught[0], name, "high")))
    for rule in spans:
        fit = F.filter(decode.scopes("enclosing_scopes"), _entry_of("kind", rule["kind"], "type", rule["text"]))
        allowed = ~F.col("provider").isin(list(rule.get("deny", []))) if rule.get("deny") else F.lit(True)
        found.append(F.when((F.size(fit) > 0) & allowed, _observation(rule["type"], fit[0]["kind"], fit[0]["type"], "high")))
    if payload:
        payload = [{"texts": [rule]} if isinstance(rule, str) else rule for rule in payload]
        gate = lambda rule: F.col("provider").isin(list(rule["providers"])) if rule.get("providers") else F.lit(True)
        first = F.coalesce(*[F.when(gate(rule) & F.col("type_arguments").contains(t), F.lit(t)) for rule in payload for t in rule["texts"]])
        found.append(F.when(first.isNotNull(), _observation("unserializable_payload", first, F.col("type_arguments"), "high")))
    if n_plus_1:
        variable = F.regexp_extract("enclosing_loop_detail", r"(\S+)\s+in\s", 1)
        surface = F.concat_ws(" ", "first_argument_template", "first_argument_name", "argument_templates", "argument_names")
        # names are compared as whole tokens, no pattern is built from data
        tokens = F.split(surface, r"[^\p{L}\p{Nd}_]+")
        hit = (F.col("enclosing_loop_kind") == "foreach") & (variable != "") & F.array_contains(tokens, variable)
        found.append(F.when(F.coalesce(hit, F.lit(False)), _observation("n_plus_1", variable, F.col("enclosing_loop_detail"), "medium")))
    return e.withColumn("observations", F.filter(F.array(*found), lambda x: x.isNotNull()))


def flatten_hazards(effects: DataFrame) -> DataFrame:
    """One row per effect and observation that is a hazard."""
    rows = effects.select(*[c for c in effects.columns if c != "observations"], F.explode("observations").alias("o"))
    return rows.select("*", F.col("o.type").alias("hazard"), F.col("o.confidence").alias("confidence")).where(F.col("hazard").isin(HAZARD_TYPES)).drop("o")


def filter_effects(effects: DataFrame, only: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Effects by tokens ``provider`` or ``provider:operation`` in any case; what is excluded is out in any event."""
    p = F.lower("provider")
    po = F.concat(p, F.lit(":"), F.lower("operation"))
    hit = lambda tokens: p.isin([t.lower() for t in tokens]) | po.isin([t.lower() for t in tokens])
    if only:
        effects = effects.where(hit(only))
    if exclude:
        effects = effects.where(~hit(exclude))
    return effects


def unknown_tokens(effects_or_rules: list[EffectRule], tokens: list[str]) -> list[str]:
    """Tokens that no rule's provider or provider:operation equals, in any case."""
    known = {x for r in effects_or_rules for x in (r.provider.lower(), f"{r.provider}:{r.operation}".lower())}
    return [t for t in tokens if t.lower() not in known]
