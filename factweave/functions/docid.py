"""Column functions over symbol ids (``M:Ns.Type.Member(args)``) and the names in facts. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of the language and the names of the types they stand for.
KEYWORD_TYPES = {
    "bool": "Boolean", "byte": "Byte", "char": "Char", "decimal": "Decimal", "double": "Double", "float": "Single",
    "int": "Int32", "long": "Int64", "object": "Object", "sbyte": "SByte", "short": "Int16", "string": "String",
    "uint": "UInt32", "ulong": "UInt64", "ushort": "UInt16",
}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(symbol: str | Column) -> Column:
    """The id without its parameters: what stands before the first '('."""
    return F.substring_index(_c(symbol), "(", 1)


def is_method(symbol: str | Column) -> Column:
    return _c(symbol).startswith("M:")


def strip_arity(text: str | Column) -> Column:
    """Without generic arity marks: `` List`1.Add``2 `` is List.Add."""
    return F.regexp_replace(_c(text), "`+\\d*", "")


def strip_generic(name: str | Column) -> Column:
    """The bare name of a type: cut at the first '{', then at the first '`'."""
    return F.substring_index(F.substring_index(_c(name), "{", 1), "`", 1)


def _before_last_dot(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*)\.[^.]*$", 1)


def method_type(symbol: str | Column) -> Column:
    """``T:`` and the declaring type of a method id, arity marks kept; null for other ids and ids without a dot."""
    body = F.substring(head(symbol), 3, 1 << 20)
    return F.when(is_method(symbol) & body.contains("."), F.concat(F.lit("T:"), _before_last_dot(body)))


def method_name(symbol: str | Column) -> Column:
    """The method's name, arity mark kept; null for other ids."""
    body = F.substring(head(symbol), 3, 1 << 20)
    return F.when(is_method(symbol) & body.contains("."), F.substring_index(body, ".", -1))


def declaring_type(symbol: str | Column) -> Column:
    """The declaring type's name without prefix and arity marks; null for ids other than methods."""
    return strip_arity(F.substring(method_type(symbol), 3, 1 << 20))


def _split_depth(text: Column, opening: str, closing: str) -> Column:
    """Pieces of text between commas at depth 0."""
    chars = F.split(text, "")
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("piece"), F.array().cast("array<string>").alias("done")
    )

    def step(state: Column, ch: Column) -> Column:
        depth = state["depth"] + F.when(ch.isin(list(opening)), 1).when(ch.isin(list(closing)), -1).otherwise(0)
        cut = (ch == ",") & (state["depth"] == 0)
        return F.struct(
            depth.cast("int").alias("depth"),
            F.when(cut, "").otherwise(F.concat(state["piece"], ch)).alias("piece"),
            F.when(cut, F.concat(state["done"], F.array(state["piece"]))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(chars, start, step, lambda s: F.concat(s["done"], F.array(s["piece"])))


def top_level_split(text: str | Column, brackets: str = "<>()[]") -> Column:
    """Comma-separated pieces, trimmed; commas within brackets don't separate. Null and blank text give null."""
    t = _c(text)
    pieces = _split_depth(t, brackets[::2], brackets[1::2])
    return F.when(F.trim(t) != "", F.transform(pieces, lambda x: F.trim(x)))


def nth_type_argument(text: str | Column, n: int) -> Column:
    """The n-th (from 0) of a comma-joined list of type names; null if there is none or it is blank."""
    return F.nullif(F.get(top_level_split(text, "<>()"), F.lit(n)), F.lit(""))


def param_arity(symbol: str | Column) -> Column:
    """Number of parameters in an id: commas outside of brackets, plus one; 0 without parameters."""
    params = F.regexp_extract(_c(symbol), r"(?s)\((.*)\)", 1)
    marks = F.split(F.regexp_replace(params, r"[^{}\[\](),]", ""), "")
    state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"))
    commas = F.aggregate(
        marks,
        state,
        lambda s, ch: F.struct(
            (s["d"] + F.when(ch.isin("{", "[", "("), 1).when(ch.isin("}", "]", ")"), -1).otherwise(0)).alias("d"),
            (s["n"] + F.when((ch == ",") & (s["d"] == 0), 1).otherwise(0)).alias("n"),
        ),
        lambda s: s["n"],
    )
    return F.when(F.trim(params) == "", 0).otherwise(commas + 1).cast("int")


def param_free_name(symbol: str | Column) -> Column:
    """The full name without kind prefix and parameters."""
    h = head(symbol)
    return F.when(F.substring(h, 2, 1) == ":", F.substring(h, 3, 1 << 20)).otherwise(h)


def simple_member_name(symbol: str | Column) -> Column:
    return F.substring_index(param_free_name(symbol), ".", -1)


def simple_type_name(type_id: str | Column) -> Column:
    """The last part of a type's name, without arity mark or arguments; of a type within a generic one, its own name."""
    return F.substring_index(F.substring_index(F.substring_index(param_free_name(type_id), "{", 1), ".", -1), "`", 1)


def namespace_of(type_name: str | Column) -> Column:
    """Everything before the last dot; '' without one."""
    return _before_last_dot(_c(type_name))


def lambda_container(symbol: str | Column) -> Column:
    """The id of the member that holds a lambda; null for ids that are no lambda."""
    s = _c(symbol)
    return F.when(s.contains("~λ"), F.substring_index(s, "~λ", 1))


def _balanced(text: Column) -> Column:
    """Without balanced <...>, for any nesting."""
    state = F.struct(F.lit(0).alias("d"), F.lit("").alias("t"))
    return F.aggregate(
        F.split(text, ""),
        state,
        lambda s, ch: F.struct(
            (s["d"] + F.when(ch == "<", 1).when((ch == ">") & (s["d"] > 0), -1).otherwise(0)).alias("d"),
            F.when((ch == "<") | (s["d"] > 0), s["t"]).otherwise(F.concat(s["t"], ch)).alias("t"),
        ),
        lambda s: F.when(s["d"] == 0, s["t"]),
    )


def receiver_type_id(receiver: str | Column) -> Column:
    """``T:`` id of a receiver's static type as displayed; null where it names no plain type.

    Type arguments in <...> fall away. A leading '<', and a nullable, pointer, array or compound display, is no
    plain type.
    """
    r = F.trim(_c(receiver))
    bare = _balanced(r)
    return F.when((r != "") & ~r.startswith("<") & (bare != "") & ~bare.rlike(r"[?*\[ ]"), F.concat(F.lit("T:"), strip_generic(bare)))


def first_non_blank(*candidates: str | Column) -> Column:
    """The first candidate that is neither null nor blank, as it stands.

    Each candidate is evaluated once, so nested calls don't multiply their expressions.
    """
    return F.get(F.filter(F.array(*[_c(c) for c in candidates]), lambda x: F.trim(x) != ""), F.lit(0))


def nth_json_string(array: str | Column, n: int) -> Column:
    """The n-th string of a JSON array in text; null for null entries, short arrays and malformed text."""
    return F.get(F.from_json(_c(array), "array<string>"), F.lit(n))


def normalize_http(url: str | Column) -> Column:
    """A URL without scheme and trailing '/'; a path without leading '/'."""
    u = _c(url)
    return F.when(u.contains("://"), F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "/+$", "")).otherwise(
        F.regexp_replace(u, "^/+", "")
    )


def resource_key(resource: str | Column, suffixes: list[str], simple: bool = True) -> Column:
    """A comparable key of a resource: its simple name without the longest of the suffixes that leaves something."""
    r = strip_generic(_c(resource))
    name = F.substring_index(r, ".", -1) if simple else r
    out = name
    for suffix in sorted(suffixes, key=len):  # the longest is looked at first
        out = F.when(name.endswith(suffix) & (F.length(name) > len(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return out


def type_route(type_name: str | Column, prefix: str) -> Column:
    """A page's route: the type's name after a namespace prefix, dots as slashes."""
    t = strip_arity(_c(type_name))
    rest = F.when(t.startswith(prefix + "."), F.substring(t, len(prefix) + 2, 1 << 20)).otherwise(t)
    return F.concat(F.lit("/"), F.translate(rest, ".", "/"))


def action_route(symbol: str | Column, prefix: str) -> Column:
    """An action's route: the method's full name after a prefix of its namespace, all dots but the last as slashes; null
    for ids that are no method or lie outside of the prefix. The prefix is taken as it stands."""
    body = strip_arity(F.substring(head(symbol), 3, 1 << 20))
    rest = F.substring(body, len(prefix) + 1, 1 << 20)
    at = F.regexp_extract(rest, r"(?s)^(.*)\.[^.]*$", 1)
    route = F.when(rest.contains("."), F.concat(F.translate(at, ".", "/"), F.lit("."), F.substring_index(rest, ".", -1))).otherwise(rest)
    return F.when(is_method(symbol) & body.startswith(prefix), route)


def inheritance_route(type_id: str | Column, method: str | Column) -> Column:
    """A handler's route: its type's full name and the method's; null unless the type is a ``T:`` id."""
    t = _c(type_id)
    return F.when(t.startswith("T:"), F.concat(strip_arity(F.substring(t, 3, 1 << 20)), F.lit("."), _c(method)))


def substitute_names(text: str | Column, names: dict[str, str]) -> Column:
    """Text with whole identifiers replaced, all at once: T in List<T> and not in TKey or in what was put in."""
    out = F.regexp_replace(_c(text), r"(?<![\p{L}\p{Nd}_])(?=[\p{L}_])|(?<=[\p{L}\p{Nd}_])(?![\p{L}\p{Nd}_])", "\u0001")
    parts = F.transform(F.split(out, "\u0001"), lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[x], x) if names else x)
    return F.array_join(parts, "")


def constructor_type(symbol: str | Column) -> Column:
    """The type a constructor id makes, without prefix and arity marks; null for other ids."""
    return F.when(method_name(symbol) == "#ctor", declaring_type(symbol))


def field_slot(symbol: str | Column) -> Column:
    """(type, name) of a field or property id; null for other ids."""
    body = F.substring(head(symbol), 3, 1 << 20)
    return F.when(
        _c(symbol).rlike("^[FP]:") & body.contains("."),
        F.struct(_before_last_dot(body).alias("type"), F.substring_index(body, ".", -1).alias("name")),
    )


def framework_name(keyword: str | Column) -> Column:
    """The type name of a language keyword; other names as they are."""
    k = _c(keyword)
    names = F.create_map(*[F.lit(x) for kv in KEYWORD_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(names, k), k)


def short_name(symbol: str | Column) -> Column:
    """Type and member for display: ``Type.Member``, constructors as the type, lambdas marked."""
    free = strip_arity(param_free_name(F.coalesce(lambda_container(symbol), _c(symbol))))
    two = F.substring_index(free, ".", -2)
    shown = F.when(two.endswith(".#ctor"), F.substring_index(two, ".", 1)).otherwise(two)
    return F.when(_c(symbol).contains("~λ"), F.concat(shown, F.lit(" λ"))).otherwise(shown)


def head_glob_regex(pattern: str) -> str:
    """A regular expression for a head pattern: parts between '*' occur in order, in any case, anywhere."""
    import re

    return "(?is)" + ".*".join(re.escape(p) for p in pattern.split("*"))


def matches_head_glob(symbol: str | Column, pattern: str) -> Column:
    """Whether the id before '(' holds the parts of ``pattern`` (between '*') in order, in any case."""
    return head(symbol).rlike(head_glob_regex(pattern))


def file_glob_regex(glob: str) -> str:
    """A regular expression for a path glob: ** crosses folders, * and ? don't; both slashes are alike."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*[/\\\\])?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/\\\\]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/\\\\]", i + 1
        elif glob[i] in "/\\":
            out, i = out + "[/\\\\]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?i)^(?:.*[/\\\\])?{out}$"


def is_generated_path(path: str | Column) -> Column:
    """Paths by which tools name their output."""
    p = _c(path)
    return p.contains("<generated>") | F.lower(p).rlike(r"\.(g|g\.i|designer|generated)\.cs$")
