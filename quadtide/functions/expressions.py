"""SPARQL expressions as Columns. A value is a lexical form, a kind and, where it has one, a number or
a truth value; NULL is an error or unbound."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryParseError, UnsupportedError
from ..model import BOOLEAN, DATATYPES, DATETIME, DECIMAL, INTEGER, IRI, STRING, XSD, number_text, parse_number
from ..plans.ast import Aggregate, Call, Const, Exists, IriCall, Var
from .anomaly import lookup


@dataclass
class Value:
    lex: Column
    kind: Column | int  # an int where it is known when the query is compiled
    num: Column | None = None  # for numeric values, and for terms that may be numeric
    truth: Column | None = None  # for boolean values

    @property
    def kind_column(self) -> Column:
        if isinstance(self.kind, int):
            return F.when(self.lex.isNotNull(), F.lit(self.kind)).cast("tinyint")
        return self.kind

    @property
    def number(self) -> Column:
        return self.num if self.num is not None else F.lit(None).cast("double")


def text_value(c: Column, kind: int = STRING) -> Value:
    return Value(c, kind)


def number_value(n: Column, kind: int = DECIMAL) -> Value:
    n = n.cast("double")
    return Value(number_text(n), kind, n)


def truth_value(b: Column) -> Value:
    return Value(F.when(b, "true").when(~b, "false"), BOOLEAN, None, b)


def constant(c: Const) -> Value:
    return Value(F.lit(c.lex), c.kind, F.lit(c.num) if c.num is not None else None, F.lit(c.lex == "true") if c.kind == BOOLEAN else None)


def effective_truth(v: Value) -> Column:
    """The effective boolean value: NULL for IRIs and unbound."""
    if v.truth is not None:
        return v.truth
    by_number = (v.number != 0) & ~F.isnan(v.number)
    if isinstance(v.kind, int):
        if v.kind in (DECIMAL, INTEGER):
            return by_number
        return F.length(v.lex) > 0 if v.kind == STRING else F.lit(None).cast("boolean")
    return F.when(v.number.isNotNull(), by_number).when(v.kind == STRING, F.length(v.lex) > 0).when(v.kind == BOOLEAN, v.lex == "true")


def any_number(v: Value) -> Column:
    """The number that a literal's lexical form denotes, whatever its datatype (for extension functions)."""
    if isinstance(v.kind, int):
        if v.kind in (DECIMAL, INTEGER):
            return v.number
        return F.lit(None).cast("double") if v.kind in (IRI, BOOLEAN) else parse_number(v.lex)
    return F.coalesce(v.number, F.when(v.kind != IRI, parse_number(v.lex)))


def equal(a: Value, b: Value) -> Column:
    """SPARQL "=": numbers by value, other terms by lexical form and kind; NULL where literals of
    different types can't be compared."""
    for x, y in ((a, b), (b, a)):
        if isinstance(y.kind, int):
            if y.kind in (DECIMAL, INTEGER):
                same = (x.number == y.number) & ~F.isnan(x.number) & ~F.isnan(y.number)
                if isinstance(x.kind, int):
                    return same if x.num is not None else F.lit(False) if x.kind == IRI else F.lit(None).cast("boolean")
                return F.when(x.kind == IRI, F.lit(False)).otherwise(same)
            if isinstance(x.kind, int):
                if x.kind == y.kind:
                    return x.lex == y.lex
                return F.lit(False) if IRI in (x.kind, y.kind) else F.lit(None).cast("boolean")
            return F.when(x.kind == y.kind, x.lex == y.lex).when((x.kind == IRI) | F.lit(y.kind == IRI), F.lit(False))
    numeric = a.number.isNotNull() & b.number.isNotNull()
    return F.when(numeric, (a.number == b.number) & ~F.isnan(a.number)).when(a.kind == b.kind, a.lex == b.lex).when((a.kind == IRI) | (b.kind == IRI), F.lit(False))


_ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def compare(op: str, a: Value, b: Value) -> Column:
    """Numbers by value, strings by their characters; other combinations are errors."""
    test = _ORDER[op]
    for x, y, flip in ((a, b, False), (b, a, True)):
        if isinstance(y.kind, int):
            if y.kind in (DECIMAL, INTEGER):
                if isinstance(x.kind, int) and x.num is None:
                    return F.lit(None).cast("boolean")
                order = test(y.number, x.number) if flip else test(x.number, y.number)
                return order & ~F.isnan(x.number) & ~F.isnan(y.number)
            order = test(y.lex, x.lex) if flip else test(x.lex, y.lex)
            if y.kind == IRI:
                return F.lit(None).cast("boolean")
            if isinstance(x.kind, int):
                return order if x.kind == y.kind or {x.kind, y.kind} == {STRING, DATETIME} else F.lit(None).cast("boolean")
            return F.when((x.kind == y.kind) | ((x.kind == STRING) & F.lit(y.kind == DATETIME)), order)
    numeric = a.number.isNotNull() & b.number.isNotNull()
    return F.when(numeric, test(a.number, b.number) & ~F.isnan(a.number) & ~F.isnan(b.number)).when((a.kind == b.kind) & (a.kind != IRI) & a.number.isNull(), test(a.lex, b.lex))


def same_term(a: Value, b: Value) -> Column:
    if isinstance(a.kind, int) and isinstance(b.kind, int):
        return (a.lex == b.lex) & F.lit(a.kind == b.kind)
    return (a.lex == b.lex) & (a.kind_column == b.kind_column)


def _is(v: Value, *kinds: int) -> Column:
    if isinstance(v.kind, int):
        return F.when(v.lex.isNotNull(), F.lit(v.kind in kinds))
    return v.kind.isin(*kinds)


def _string(v: Value) -> Column:
    """The text of a literal; NULL for an IRI."""
    if isinstance(v.kind, int):
        return F.lit(None).cast("string") if v.kind == IRI else v.lex
    return F.when(v.kind != IRI, v.lex)


def _time(v: Value) -> Column:
    return _string(v).try_cast("timestamp")


def _zone(text: Column) -> Column:
    return F.regexp_extract(text, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)


def _encode(text: Column) -> Column:
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


class Compiler:
    """Compiles expressions over an environment of variables. now_ms: the query's NOW()."""

    def __init__(self, env: Callable[[str], Value | None], now_ms: int | None = None, aggregate: Callable[[Aggregate], Value] | None = None):
        self.env, self.now_ms, self.aggregate = env, now_ms, aggregate

    def value(self, e) -> Value:
        if isinstance(e, Var):
            got = self.env(e.name)
            return got if got is not None else Value(F.lit(None).cast("string"), F.lit(None).cast("tinyint"), F.lit(None).cast("double"))
        if isinstance(e, Const):
            return constant(e)
        if isinstance(e, Aggregate):
            if self.aggregate is None:
                raise QueryParseError(f"{e.name.upper()} can't stand here")
            return self.aggregate(e)
        if isinstance(e, Exists):
            raise UnsupportedError("EXISTS is supported as a FILTER of its own or joined to others by &&")
        if isinstance(e, IriCall):
            return self.iri_call(e)
        if isinstance(e, Call):
            method = getattr(self, "f_" + e.name, None)
            if method is not None:
                return self.checked(method, e)
            return self.operator(e)
        raise QueryParseError(f"not an expression: {e!r}")

    def checked(self, method, e: Call) -> Value:
        try:
            return method(*e.args)
        except TypeError as err:
            if "positional argument" in str(err):
                raise QueryParseError(f"wrong number of arguments for {e.name.upper()}") from None
            raise

    def truth(self, e) -> Column:
        return effective_truth(self.value(e))

    def num(self, e) -> Column:
        return self.value(e).number

    def text(self, e) -> Column:
        return _string(self.value(e))

    def operator(self, e: Call) -> Value:
        op, args = e.name, e.args
        if op == "and":
            return truth_value(self.truth(args[0]) & self.truth(args[1]))
        if op == "or":
            return truth_value(self.truth(args[0]) | self.truth(args[1]))
        if op == "not":
            return truth_value(~self.truth(args[0]))
        if op == "=":
            return truth_value(equal(self.value(args[0]), self.value(args[1])))
        if op == "!=":
            return truth_value(~equal(self.value(args[0]), self.value(args[1])))
        if op in _ORDER:
            return truth_value(compare(op, self.value(args[0]), self.value(args[1])))
        if op == "in":
            left, out = self.value(args[0]), F.lit(False)
            for a in args[1:]:
                out = out | equal(left, self.value(a))
            return truth_value(out)
        if op == "negate":
            return number_value(-self.num(args[0]))
        left, right = self.value(args[0]), self.value(args[1])
        whole = op != "/" and all(isinstance(v.kind, int) and v.kind == INTEGER for v in (left, right))
        a, b = left.number, right.number
        return number_value({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op](), INTEGER if whole else DECIMAL)

    def iri_call(self, e: IriCall) -> Value:
        if e.iri.startswith(XSD):
            return self.cast(e.iri[len(XSD):], e.args)
        f = lookup(e.iri)
        if f is None:
            raise QueryParseError(f"unknown function <{e.iri}>")
        if len(e.args) != f.arity:  # the wrong number of arguments is an error in every row
            return truth_value(F.lit(None).cast("boolean"))
        args = [any_number(self.value(a)) for a in e.args]
        known = F.lit(True)
        for a in args:
            known = known & a.isNotNull()
        out = F.when(known, f.build(*args))
        return truth_value(out) if f.boolean else number_value(out)

    def cast(self, name: str, args: list) -> Value:
        if len(args) != 1:
            raise QueryParseError(f"xsd:{name} takes one argument")
        v = self.value(args[0])
        if name in ("decimal", "double", "float"):
            n = F.coalesce(any_number(v), F.when(v.lex == "true", 1.0).when(v.lex == "false", 0.0))
            return number_value(n)
        if name in ("integer", "int", "long"):
            n = F.coalesce(any_number(v), F.when(v.lex == "true", 1.0).when(v.lex == "false", 0.0))
            return number_value(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)), INTEGER)
        if name == "string":
            return text_value(v.lex)
        if name == "boolean":
            n = any_number(v)
            return truth_value(F.when(v.lex.isin("true", "1"), True).when(v.lex.isin("false", "0"), False).when(n.isNotNull(), (n != 0) & ~F.isnan(n)))
        if name == "dateTime":
            return Value(F.when(_time(v).isNotNull(), _string(v)), DATETIME)
        raise QueryParseError(f"unknown function <{XSD}{name}>")

    # functional forms
    def f_bound(self, v):
        return truth_value(self.value(v).lex.isNotNull())

    def f_if(self, test, yes, no):
        t, a, b = self.truth(test), self.value(yes), self.value(no)
        pick = lambda x, y: F.when(t, x).when(~t, y)
        return Value(pick(a.lex, b.lex), pick(a.kind_column, b.kind_column), pick(a.number, b.number))

    def f_coalesce(self, *args):
        values = [self.value(a) for a in args]
        lex = F.coalesce(*(v.lex for v in values))
        kind, num = F.lit(None).cast("tinyint"), F.lit(None).cast("double")
        for v in reversed(values):
            kind = F.when(v.lex.isNotNull(), v.kind_column).otherwise(kind)
            num = F.when(v.lex.isNotNull(), v.number).otherwise(num)
        return Value(lex, kind, num)

    def f_sameterm(self, a, b):
        return truth_value(same_term(self.value(a), self.value(b)))

    # terms
    def f_isiri(self, v):
        return truth_value(_is(self.value(v), IRI))

    f_isuri = f_isiri

    def f_isblank(self, v):
        return truth_value(F.when(self.value(v).lex.isNotNull(), F.lit(False)))

    def f_isliteral(self, v):
        return truth_value(~_is(self.value(v), IRI))

    def f_isnumeric(self, v):
        x = self.value(v)
        return truth_value(F.when(x.lex.isNotNull(), x.number.isNotNull()))

    def f_str(self, v):
        return text_value(self.value(v).lex)

    def f_lang(self, v):
        return text_value(F.when(self.text(v).isNotNull(), ""))

    def f_langmatches(self, tag, wanted):
        t, r = F.lower(self.text(tag)), F.lower(self.text(wanted))
        return truth_value(F.when(r == "*", t != "").otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))

    def f_datatype(self, v):
        x = self.value(v)
        if isinstance(x.kind, int):
            return Value(F.when(x.lex.isNotNull() & F.lit(x.kind != IRI), XSD + DATATYPES.get(x.kind, "")), IRI)
        out = F.when(x.kind == STRING, XSD + "string")
        for k, name in DATATYPES.items():
            out = out.when(x.kind == k, XSD + name)
        return Value(out, IRI)

    def f_iri(self, v):
        return Value(self.value(v).lex, IRI)

    f_uri = f_iri

    def f_strdt(self, v, datatype):
        text, kind = self.text(v), self.value(datatype).lex
        out, num = F.when(kind == XSD + "string", F.lit(STRING)), parse_number(text)
        for k, name in DATATYPES.items():
            out = out.when(kind == XSD + name, k)
        out = out.when(kind.isin(XSD + "double", XSD + "float"), DECIMAL).otherwise(STRING).cast("tinyint")
        return Value(text, out, F.when(out.isin(DECIMAL, INTEGER), num))

    def f_strlang(self, v, tag):
        return text_value(F.when(self.text(tag).isNotNull(), self.text(v)))

    def f_uuid(self):
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI)

    def f_struuid(self):
        return text_value(F.uuid())

    def f_bnode(self, *args):
        raise UnsupportedError("BNODE: the data model has no blank nodes")

    # strings
    def f_strlen(self, v):
        return number_value(F.length(self.text(v)), INTEGER)

    def f_substr(self, v, start, length=None):
        s, begin = self.text(v), F.round(self.num(start)).cast("int")
        if length is None:
            return text_value(F.substr(s, F.greatest(begin, F.lit(1))))
        end = begin + F.round(self.num(length)).cast("int")
        first = F.greatest(begin, F.lit(1))
        return text_value(F.substr(s, first, F.greatest(end - first, F.lit(0))))

    def f_ucase(self, v):
        return text_value(F.upper(self.text(v)))

    def f_lcase(self, v):
        return text_value(F.lower(self.text(v)))

    def f_strstarts(self, a, b):
        return truth_value(F.startswith(self.text(a), self.text(b)))

    def f_strends(self, a, b):
        return truth_value(F.endswith(self.text(a), self.text(b)))

    def f_contains(self, a, b):
        return truth_value(F.contains(self.text(a), self.text(b)))

    def f_strbefore(self, a, b):
        s, mark = self.text(a), self.text(b)
        at = F.call_function("locate", mark, s)
        return text_value(F.when(at > 0, F.substr(s, F.lit(1), at - 1)).when(at == 0, ""))

    def f_strafter(self, a, b):
        s, mark = self.text(a), self.text(b)
        at = F.call_function("locate", mark, s)
        return text_value(F.when(at > 0, F.substr(s, at + F.length(mark))).when(at == 0, ""))

    def f_encode_for_uri(self, v):
        return text_value(_encode(self.text(v)))

    def f_concat(self, *args):
        return text_value(F.concat(*(self.text(a) for a in args)) if args else F.lit(""))

    def _pattern(self, pattern, flags) -> Column:
        p = self.text(pattern)
        if flags is None:
            return p
        if not isinstance(flags, Const) or set(flags.lex) - set("smixq"):
            raise UnsupportedError("REGEX flags must be a constant of s, m, i, x and q")
        if "q" in flags.lex:
            p = F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        known = flags.lex.replace("q", "")
        return F.concat(F.lit(f"(?{known})"), p) if known else p

    def f_regex(self, v, pattern, flags=None):
        return truth_value(F.rlike(self.text(v), self._pattern(pattern, flags)))

    def f_replace(self, v, pattern, by, flags=None):
        return text_value(F.regexp_replace(self.text(v), self._pattern(pattern, flags), self.text(by)))

    # numbers
    def f_abs(self, v):
        return self._kept(v, F.abs)

    def f_ceil(self, v):
        return self._kept(v, F.ceil)

    def f_floor(self, v):
        return self._kept(v, F.floor)

    def f_round(self, v):  # halves go up
        return self._kept(v, lambda n: F.floor(n + 0.5))

    def _kept(self, v, f: Callable[[Column], Column]) -> Value:
        x = self.value(v)
        return number_value(f(x.number), INTEGER if isinstance(x.kind, int) and x.kind == INTEGER else DECIMAL)

    def f_rand(self):
        return number_value(F.rand())

    # times
    def f_now(self):
        import time

        ms = self.now_ms if self.now_ms is not None else int(time.time() * 1000)
        return Value(F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), DATETIME)

    def _part(self, v, f) -> Value:
        return number_value(f(_time(self.value(v))), INTEGER)

    def f_year(self, v):
        return self._part(v, F.year)

    def f_month(self, v):
        return self._part(v, F.month)

    def f_day(self, v):
        return self._part(v, F.dayofmonth)

    def f_hours(self, v):
        return self._part(v, F.hour)

    def f_minutes(self, v):
        return self._part(v, F.minute)

    def f_seconds(self, v):
        t = _time(self.value(v))
        return number_value(F.second(t) + (F.unix_micros(t) % 1000000) / 1000000)

    def f_tz(self, v):
        s = self.text(v)
        return text_value(F.when(s.isNotNull(), _zone(s)))

    def f_timezone(self, v):
        z = _zone(self.text(v))
        hours, minutes = F.substr(z, F.lit(2), F.lit(2)).try_cast("int"), F.substr(z, F.lit(5), F.lit(2)).try_cast("int")
        sign = F.when(z.startswith("-"), "-").otherwise("")
        body = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        zero = (z == "Z") | ((hours == 0) & (minutes == 0))
        return text_value(F.when(zero, "PT0S").when(z != "", body))

    # digests
    def f_md5(self, v):
        return text_value(F.md5(self.text(v)))

    def f_sha1(self, v):
        return text_value(F.sha1(self.text(v)))

    def f_sha256(self, v):
        return text_value(F.sha2(self.text(v), 256))

    def f_sha384(self, v):
        return text_value(F.sha2(self.text(v), 384))

    def f_sha512(self, v):
        return text_value(F.sha2(self.text(v), 512))
