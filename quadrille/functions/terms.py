"""Term functions: constructors, accessors, tests, casts and string functions.

A *term* is a struct ``(value, kind, datatype, lang)``; an unbound variable is
NULL and so is a type error, which is what makes FILTER drop the row and BIND
leave the variable unbound.  All functions are plain Column expressions.
"""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quadrille.model import RDF, XSD

# Fixed list: the XSD types that take part in arithmetic.
INTEGER_TYPES = [XSD + t for t in (
    "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte",
    "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
    "positiveInteger")]
DECIMAL, FLOAT, DOUBLE = XSD + "decimal", XSD + "float", XSD + "double"
NUMERIC_TYPES = [*INTEGER_TYPES, DECIMAL, FLOAT, DOUBLE]
STRING, BOOLEAN = XSD + "string", XSD + "boolean"
DATETIME, DATE, INTEGER = XSD + "dateTime", XSD + "date", XSD + "integer"
LANG_STRING = RDF + "langString"



def _s(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# -- constructors -----------------------------------------------------------

def term(value, kind, datatype=None, lang=None) -> Column:
    return F.struct(_s(value).cast("string").alias("value"), _s(kind).alias("kind"),
                    _s(datatype).cast("string").alias("datatype"),
                    _s(lang).cast("string").alias("lang"))


def _unless_null(c: Column, t: Column) -> Column:
    return F.when(c.isNotNull(), t)


def literal(value, datatype=None, lang=None) -> Column:
    v = _s(value)
    return _unless_null(v, term(v, "literal", datatype, lang))


def resource(value) -> Column:
    """An IRI or blank-node term; NULL stays unbound."""
    v = _s(value)
    return _unless_null(v, term(v, F.when(v.startswith("_:"), "bnode").otherwise("iri")))


def object_term() -> Column:
    """The object of a quads row as a term."""
    return term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang"))


def boolean(c: Column) -> Column:
    return literal(c.cast("string"), BOOLEAN)


# -- accessors and tests ----------------------------------------------------

def bound(t: Column) -> Column:
    return t.isNotNull()


def coalesce(*ts: Column) -> Column:
    return F.coalesce(*ts)


def if_(cond: Column, yes: Column, no: Column) -> Column:
    """IF: an error in the condition is an error of the whole expression."""
    return F.when(cond, yes).when(~cond, no)


def is_iri(t: Column) -> Column:
    return t["kind"] == "iri"


def is_blank(t: Column) -> Column:
    return t["kind"] == "bnode"


def is_literal(t: Column) -> Column:
    return t["kind"] == "literal"


def str_(t: Column) -> Column:
    """STR: the lexical form, never re-serialised; blank nodes have none."""
    return F.when(t["kind"] != "bnode", literal(t["value"]))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), literal(F.coalesce(t["lang"], F.lit(""))))


def datatype_iri(t: Column) -> Column:
    filled = F.when(t["lang"].isNotNull(), F.lit(LANG_STRING)).otherwise(
        F.coalesce(t["datatype"], F.lit(STRING)))
    return F.when(is_literal(t), filled)


def datatype(t: Column) -> Column:
    return resource(datatype_iri(t))


def lang_matches(tag: Column, pattern: Column) -> Column:
    """RFC 4647 basic filtering; ``*`` matches any non-empty tag."""
    v, r = F.lower(tag["value"]), F.lower(pattern["value"])
    return F.when(r == "*", v != "").otherwise((v == r) | v.startswith(F.concat(r, F.lit("-"))))


def decimal_value(t: Column) -> Column:
    """Exact numeric value, NULL for doubles and non-numbers."""
    exact = t["datatype"].isin(DECIMAL, *INTEGER_TYPES) & is_literal(t)
    fits = t["value"].rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    return F.when(exact & fits, t["value"].try_cast("decimal(38,18)"))


def integer_value(t: Column) -> Column:
    """Exact value of an integer type up to 38 digits, else NULL."""
    whole = t["value"].rlike(r"^[+-]?\d+$")
    return F.when(is_literal(t) & t["datatype"].isin(*INTEGER_TYPES) & whole, t["value"].try_cast("decimal(38,0)"))


def double_value(t: Column) -> Column:
    """Numeric value as double, with XSD spellings of the special values."""
    v = t["value"]
    spelled = (F.when(v == "INF", F.lit("Infinity")).when(v == "-INF", F.lit("-Infinity"))
               .when(v.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(v))
               .when(v == "NaN", v))
    return F.when(is_literal(t) & t["datatype"].isin(NUMERIC_TYPES), spelled.try_cast("double"))


def is_numeric(t: Column) -> Column:
    return F.when(t.isNotNull(), double_value(t).isNotNull())


def boolean_value(t: Column) -> Column:
    v = t["value"]
    return F.when(is_literal(t) & (t["datatype"] == BOOLEAN),
                  F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False))


def is_string(t: Column) -> Column:
    return (is_literal(t) & t["lang"].isNull()
            & F.coalesce(t["datatype"], F.lit(STRING)).isin(STRING))


def ebv(t: Column) -> Column:
    """Effective boolean value: NULL (error) for IRIs, dates, unknown types."""
    number = double_value(t)
    return (
        F.when(is_literal(t) & (t["datatype"] == BOOLEAN),
               F.coalesce(boolean_value(t), F.lit(False)))
        .when(is_literal(t) & t["datatype"].isin(NUMERIC_TYPES),
              F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))
        .when(is_string(t) | (is_literal(t) & t["lang"].isNotNull()), F.length(t["value"]) > 0)
    )


def not_(c: Column) -> Column:
    return ~c


def and_(a: Column, b: Column) -> Column:
    """Three-valued: false AND error = false (SQL logic already says so)."""
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


# -- comparison -------------------------------------------------------------

_ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def instant(t: Column) -> Column:
    """xsd:dateTime as a timestamp; without a zone it is read as UTC."""
    v = t["value"]
    zoned = F.when(v.rlike(_ZONE), v).otherwise(F.concat(v, F.lit("Z")))
    return F.when(is_literal(t) & (t["datatype"] == DATETIME), zoned.try_cast("timestamp"))


def _day_span(t: Column) -> tuple[Column, Column, Column]:
    """Seconds spanned by the start of an xsd:date: ±14 h without a zone."""
    v = t["value"]
    zone = F.regexp_extract(v, r"^-?\d{4,}-\d{2}-\d{2}" + _ZONE, 1)
    day = F.unix_date(F.regexp_extract(v, r"^(-?\d{4,}-\d{2}-\d{2})", 1).try_cast("date")) * 86400
    hours = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60
    shift = F.when(zone.startswith("-"), hours).when(zone.startswith("+"), -hours).otherwise(0)
    slack = F.when(zone == "", 14 * 3600).otherwise(0)
    return day + shift - slack, day + shift + slack, zone == ""


def date_eq(a: Column, b: Column) -> Column:
    """xsd:date equality; NULL when one side lacks a zone and the 14 h
    uncertainty makes the answer unknown."""
    a0, a1, a_open = _day_span(a)
    b0, b1, b_open = _day_span(b)
    return (F.when(a_open == b_open, a0 == b0)
            .when((a1 < b0) | (b1 < a0), False))


def same_term(a: Column, b: Column) -> Column:
    """sameTerm: identical value, kind, datatype and (caseless) language."""
    return F.when(
        a.isNotNull() & b.isNotNull(),
        (a["value"] == b["value"]) & (a["kind"] == b["kind"])
        & datatype_iri(a).eqNullSafe(datatype_iri(b))
        & F.lower(a["lang"]).eqNullSafe(F.lower(b["lang"])))


def _moment_cmp(a: Column, op: str, b: Column) -> Column:
    """dateTime comparison; NULL while one side lacks a zone and the 14 hours
    that it may be off leave the answer open."""
    ta, tb = instant(a), instant(b)
    za, zb = a["value"].rlike(_ZONE), b["value"].rlike(_ZONE)
    apart = F.abs(F.unix_micros(ta) - F.unix_micros(tb)) > 14 * 3600 * 1_000_000
    return F.when((za == zb) | apart, _ordered(ta, op, tb))


def _ordered(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def term_cmp(a: Column, op: str, b: Column) -> Column:
    """Typed comparison; NULL where the two terms cannot be compared.

    Numbers compare exactly while both sides are integer/decimal and as
    doubles otherwise.
    """
    if op == "!=":
        return ~term_cmp(a, "=", b)
    ia, ib = integer_value(a), integer_value(b)
    da, db = decimal_value(a), decimal_value(b)
    na, nb = double_value(a), double_value(b)
    ta, tb = instant(a), instant(b)
    ba, bb = boolean_value(a), boolean_value(b)
    dates = (datatype_iri(a) == DATE) & (datatype_iri(b) == DATE)
    typed = (F.when(ia.isNotNull() & ib.isNotNull(), _ordered(ia, op, ib))
             .when(da.isNotNull() & db.isNotNull(), _ordered(da, op, db))
             .when(na.isNotNull() & nb.isNotNull(), _ordered(na, op, nb) & ~F.isnan(na) & ~F.isnan(nb))
             .when(is_string(a) & is_string(b), _ordered(a["value"], op, b["value"]))
             .when(ba.isNotNull() & bb.isNotNull(), _ordered(ba, op, bb))
             .when(ta.isNotNull() & tb.isNotNull(), _moment_cmp(a, op, b)))
    if op != "=":
        a0, b0 = _day_span(a)[0], _day_span(b)[0]
        strict = typed.when(dates, _ordered(a0, op, b0))
        if op in ("<=", ">="):   # identical terms of an unknown type are equal
            return strict.when(same_term(a, b), True)
        return strict
    either_lang = a["lang"].isNotNull() != b["lang"].isNotNull()
    one_date = (datatype_iri(a) == DATE) != (datatype_iri(b) == DATE)
    both_lang = a["lang"].isNotNull() & b["lang"].isNotNull()
    both_literal = is_literal(a) & is_literal(b)
    return (typed.when(~both_literal, same_term(a, b))
            .when(both_literal & either_lang, False)
            .when(both_literal & one_date, False)
            .when(dates, date_eq(a, b))
            .when(both_lang, same_term(a, b))
            .when(same_term(a, b), True))


def in_(t: Column, members: list[Column]) -> Column:
    """IN as a chain of ``=``; NULL members make a miss unknown."""
    return reduce(lambda x, y: x | y, [term_cmp(t, "=", x) for x in members], F.lit(False))


def not_in(t: Column, members: list[Column]) -> Column:
    return ~in_(t, members)


# -- arithmetic -------------------------------------------------------------

def _number_text(c: Column) -> Column:
    """Canonical text of an exact number: no trailing zeros, no dangling dot."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def result_type(a: Column, b: Column) -> Column:
    """Promotion: double > float > decimal > integer."""
    def has(t):
        return (a["datatype"] == t) | (b["datatype"] == t)
    return (F.when(has(DOUBLE), DOUBLE).when(has(FLOAT), FLOAT)
            .when(has(DECIMAL), DECIMAL).otherwise(INTEGER))


@F.pandas_udf(T.StringType())
def _quotient(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Decimal quotients to 18 places, which Spark's own division cuts to six."""
    def one(x, y):
        if x is None or y is None:
            return None
        with localcontext(Context(prec=60)):
            q = (Decimal(x) / Decimal(y)).quantize(Decimal(1).scaleb(-18))
        text = f"{q:f}".rstrip("0").rstrip(".")
        return "0" if text in ("-0", "") else text
    return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype=object)


def arith(a: Column, op: str, b: Column) -> Column:
    """``+ - * /`` with promotion; integer division gives a decimal and
    division of exact numbers by zero is an error."""
    def apply(x, y, exact):
        if op == "/":
            return F.try_divide(x, y) if exact else F.when(
                y == 0, F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf")))
                .otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(x, y))
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)

    kind = result_type(a, b)
    if op == "/":
        kind = F.when(kind == INTEGER, DECIMAL).otherwise(kind)
    ia, ib = integer_value(a), integer_value(b)
    da, db = decimal_value(a), decimal_value(b)
    if op == "/":
        exact = F.when(db != 0, _quotient(da.cast("string"), db.cast("string")))
    else:
        exact = F.when(ia.isNotNull() & ib.isNotNull(), apply(ia, ib, True).cast("string")).otherwise(_number_text(apply(da, db, True)))
    approx = apply(double_value(a), double_value(b), False)
    # an exact result that does not fit is an error, never a double
    both_exact = (a["datatype"].isin(DECIMAL, *INTEGER_TYPES) & b["datatype"].isin(DECIMAL, *INTEGER_TYPES))
    return (F.when(both_exact, F.when(exact.isNotNull(), literal(exact, kind)))
            .otherwise(literal(approx.cast("string"), kind)))


def negate(t: Column) -> Column:
    return arith(literal("0", INTEGER), "-", t)


def _rounded(t: Column, exact, approx) -> Column:
    d = decimal_value(t)
    return F.when(d.isNotNull(), literal(_number_text(exact(d)), t["datatype"])).otherwise(
        literal(approx(double_value(t)).cast("string"), t["datatype"]))


def abs_(t: Column) -> Column:
    return _rounded(t, F.abs, F.abs)


def round_(t: Column) -> Column:
    """Halves go toward positive infinity."""
    half = F.lit("0.5").cast("decimal(2,1)")
    return _rounded(t, lambda d: F.floor(d + half), lambda x: F.floor(x + 0.5).cast("double"))


def ceil_(t: Column) -> Column:
    return _rounded(t, F.ceil, lambda x: F.ceil(x).cast("double"))


def floor_(t: Column) -> Column:
    return _rounded(t, F.floor, lambda x: F.floor(x).cast("double"))


def rand_() -> Column:
    return literal(F.rand().cast("string"), DOUBLE)


def now_() -> Column:
    return literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), DATETIME)


# -- term makers ------------------------------------------------------------

def iri(t: Column, base: str = "") -> Column:
    """IRI(): a relative reference is resolved against ``base`` by RFC 3986."""
    v = t["value"]
    absolute = v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    ok = is_iri(t) | is_string(t)

    @F.pandas_udf(T.StringType())
    def resolved(texts: pd.Series) -> pd.Series:
        return texts.map(lambda r: urljoin(base, r), na_action="ignore")

    relative = resolved(v) if base else v
    return F.when(ok, resource(F.when(absolute, v).otherwise(relative)))


def bnode(label: Column, row_id: Column) -> Column:
    """BNODE(label): one blank node per (solution, label)."""
    return resource(F.concat(F.lit("_:b"), F.substring(F.sha2(
        F.concat_ws("\u0001", row_id.cast("string"), label["value"]), 256), 1, 24)))


def strdt(t: Column, datatype_: Column) -> Column:
    return F.when(is_string(t), literal(t["value"], datatype_["value"]))


def strlang(t: Column, tag: Column) -> Column:
    return F.when(is_string(t) & (tag["value"] != ""), literal(t["value"], None, tag["value"]))


def uuid_() -> Column:
    return resource(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid() -> Column:
    return literal(F.uuid())


# -- strings ----------------------------------------------------------------

def is_text(t: Column) -> Column:
    """A string argument: plain, xsd:string or language-tagged."""
    return is_literal(t) & (is_string(t) | t["lang"].isNotNull())


def _keep(t: Column, value: Column) -> Column:
    """Result of a string function: keeps the language or string type."""
    return F.when(is_text(t), literal(value, t["datatype"], t["lang"]))


def compatible(a: Column, b: Column) -> Column:
    """Argument compatibility: the second is plain or has the same language."""
    return is_text(a) & is_text(b) & (b["lang"].isNull() | (F.lower(a["lang"]) == F.lower(b["lang"])))


def strlen(t: Column) -> Column:
    return F.when(is_text(t), literal(F.length(t["value"]), INTEGER))


def substr(t: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions from ``start`` up to ``start + length``, both
    rounded; positions outside of the string are none."""
    first = F.floor(start + F.lit(0.5))
    after = F.length(t["value"]) + 1 if length is None else first + F.floor(length + F.lit(0.5))
    begin = F.greatest(first, F.lit(1))
    return _keep(t, t["value"].substr(begin.cast("int"), F.greatest(after - begin, F.lit(0)).cast("int")))


def ucase(t: Column) -> Column:
    return _keep(t, F.upper(t["value"]))


def lcase(t: Column) -> Column:
    return _keep(t, F.lower(t["value"]))


def strstarts(t: Column, x: Column) -> Column:
    return F.when(compatible(t, x), t["value"].startswith(x["value"]))


def strends(t: Column, x: Column) -> Column:
    return F.when(compatible(t, x), t["value"].endswith(x["value"]))


def contains(t: Column, x: Column) -> Column:
    return F.when(compatible(t, x), t["value"].contains(x["value"]))


def strbefore(t: Column, x: Column) -> Column:
    """Empty *simple* literal when there is no match."""
    at = F.position(x["value"], t["value"])
    hit = literal(F.substring(t["value"], F.lit(1), at - 1), t["datatype"], t["lang"])
    return F.when(compatible(t, x), F.when(x["value"] == "", literal(F.lit(""), t["datatype"], t["lang"]))
                  .when(at > 0, hit).otherwise(literal("")))


def strafter(t: Column, x: Column) -> Column:
    at = F.position(x["value"], t["value"])
    hit = literal(F.substring(t["value"], at + F.length(x["value"]), F.length(t["value"])),
                  t["datatype"], t["lang"])
    return F.when(compatible(t, x), F.when(x["value"] == "", t).when(at > 0, hit).otherwise(literal("")))


def encode_for_uri(t: Column) -> Column:
    """RFC 3986 percent encoding: only unreserved characters stay."""
    v = F.url_encode(t["value"])
    v = F.regexp_replace(v, r"\+", "%20")
    v = F.regexp_replace(v, r"\*", "%2A")
    return F.when(is_text(t), literal(F.regexp_replace(v, "%7E", "~")))


def concat(*ts: Column) -> Column:
    """Keeps a language only when every argument has the same one."""
    same = reduce(lambda x, y: x & y, [t["lang"].eqNullSafe(ts[0]["lang"]) for t in ts])
    ok = reduce(lambda x, y: x & y, [is_text(t) for t in ts])
    return F.when(ok, literal(F.concat(*[t["value"] for t in ts]), None,
                              F.when(same, ts[0]["lang"])))


def _pattern(pattern: str, flags: str) -> str:
    """SPARQL flags as inline regex flags; ``q`` quotes the pattern."""
    if "q" in flags:
        pattern = r"\Q" + pattern + r"\E"
    inline = "".join(f for f in flags if f in "ismx")
    return f"(?{inline}){pattern}" if inline else pattern


def regex(t: Column, pattern: str, flags: str = "") -> Column:
    return F.when(is_text(t), t["value"].rlike(_pattern(pattern, flags)))


def replace(t: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return _keep(t, F.regexp_replace(t["value"], _pattern(pattern, flags), replacement))


def _hash(t: Column, value: Column) -> Column:
    return F.when(is_string(t), literal(value))


def md5(t: Column) -> Column:
    return _hash(t, F.md5(t["value"]))


def sha1(t: Column) -> Column:
    return _hash(t, F.sha1(t["value"]))


def sha(t: Column, bits: int) -> Column:
    return _hash(t, F.sha2(t["value"], bits))


# -- dates: always from the lexical form, in the literal's own zone ----------

_DT = r"^(-?\d{4,})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?))?(Z|[+-]\d{2}:\d{2})?$"


def _field(t: Column, group: int, datatype_: str = INTEGER) -> Column:
    text = F.when(is_literal(t) & t["datatype"].isin(DATETIME, DATE),
                  F.regexp_extract(t["value"], _DT, group))
    plain = F.regexp_replace(text, r"^(-?)0+(?=\d)", "$1")
    return F.when(text != "", literal(plain, datatype_))


def year(t: Column) -> Column:
    return _field(t, 1)


def month(t: Column) -> Column:
    return _field(t, 2)


def day(t: Column) -> Column:
    return _field(t, 3)


def hours(t: Column) -> Column:
    return _field(t, 4)


def minutes(t: Column) -> Column:
    return _field(t, 5)


def seconds(t: Column) -> Column:
    return _field(t, 6, DECIMAL)


def tz(t: Column) -> Column:
    return F.when(is_literal(t) & (t["datatype"] == DATETIME),
                  literal(F.regexp_extract(t["value"], _DT, 7)))


def timezone(t: Column) -> Column:
    """The zone as xsd:dayTimeDuration; an error when there is none."""
    zone = tz(t)["value"]
    sign = F.when(zone.startswith("-"), "-").otherwise("")
    h = F.substring(zone, 2, 2).try_cast("int")
    n = F.substring(zone, 5, 2).try_cast("int")
    text = (F.when((zone == "Z") | ((h == 0) & (n == 0)), "PT0S")
            .when(zone != "", F.concat(sign, F.lit("PT"),
                                       F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""),
                                       F.when(n > 0, F.concat(n.cast("string"), F.lit("M"))).otherwise(""))))
    return literal(text, XSD + "dayTimeDuration")


# -- casts ------------------------------------------------------------------

def cast(t: Column, datatype_: str) -> Column:
    """xsd constructor functions; NULL when the lexical form does not fit."""
    v = t["value"]
    number = double_value(t)
    flag = boolean_value(t)
    from_text = is_string(t)
    kind = datatype_.removeprefix(XSD)
    if kind == "string":
        return F.when(t["kind"] != "bnode", literal(v, STRING))
    if kind == "integer":
        whole = F.when(from_text & v.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v).try_cast("decimal(38,0)"))
        truncated = F.when(~F.isnan(number) & (F.abs(number) < 1e37),
                           F.coalesce(F.when(decimal_value(t) >= 0, F.floor(decimal_value(t)))
                                      .otherwise(F.ceil(decimal_value(t))),
                                      F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))))
        value = F.coalesce(whole, truncated.cast("decimal(38,0)"), flag.cast("int").cast("decimal(38,0)"))
        return literal(value.cast("string"), INTEGER)
    if kind == "decimal":
        text = F.when(from_text & v.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"),
                      F.trim(v).try_cast("decimal(38,18)"))
        value = F.coalesce(text, decimal_value(t), number.try_cast("decimal(38,18)"),
                           flag.cast("int").cast("decimal(38,18)"))
        return literal(_number_text(value), DECIMAL)
    if kind in ("float", "double"):
        text = double_value(term(v, "literal", DOUBLE))
        value = F.coalesce(F.when(from_text, text), number, flag.cast("int").cast("double"))
        return literal(value.cast(kind).cast("string"), datatype_)
    if kind == "boolean":
        text = F.when(from_text & v.isin("true", "1"), True).when(from_text & v.isin("false", "0"), False)
        value = F.coalesce(text, flag, (number != 0) & ~F.isnan(number))
        return literal(value.cast("string"), BOOLEAN)
    if kind == "dateTime":
        pattern = r"^-?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
        ok = from_text | (t["datatype"] == DATETIME)
        return F.when(ok & v.rlike(pattern), literal(v, DATETIME))
    raise ValueError(f"no cast to {datatype_}")


# -- ordering ---------------------------------------------------------------

def order_key(t: Column) -> Column:
    """Sortable struct: unbound < blank < IRI < literal; numbers by value,
    then lexical form."""
    rank = (F.when(t.isNull(), 0).when(t["kind"] == "bnode", 1)
            .when(t["kind"] == "iri", 2).otherwise(3))
    moment = F.coalesce(instant(t).cast("double"), boolean_value(t).cast("double"), double_value(t))
    return F.struct(rank.alias("rank"), moment.isNull().alias("text"),
                    moment.alias("number"), t["value"].alias("value"))
