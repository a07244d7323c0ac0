"""Package versions: order, specifiers, requirements and markers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from .arrays import let

# The version grammar, and specifier operators, longest first.
GRAMMAR = (
    r"(?i)^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
OPERATORS = ["===", "~=", "==", "!=", "<=", ">=", "<", ">"]
#: Segments of a release, and digits of a number, that a sort key holds.
SEGMENTS, DIGITS = 6, 10


def _number(text: Column) -> Column:
    return F.lpad(F.regexp_replace(F.coalesce(F.nullif(text, F.lit("")), F.lit("0")), "^0+(?=[0-9])", ""), DIGITS, "0")


#: Puts the ten groups of the grammar side by side, so that one match gives them all.
_GROUPS, _BETWEEN = "\x1f".join(f"${i}" for i in range(1, 11)), "\x1f"


def _parts(text: Column) -> Column:
    """The groups of the grammar, in lower case; a text that is no version is one part."""
    return F.split(F.lower(F.regexp_replace(text, GRAMMAR, _GROUPS)), _BETWEEN)


def is_version(text: Column) -> Column:
    return text.rlike(GRAMMAR)


def _public(p: Column) -> Column:
    """The sort key of a version's groups without its local part."""
    part = lambda i: F.element_at(p, i)
    release = F.split(part(2), r"\.")
    padded = F.array_join(F.transform(F.slice(F.concat(release, F.array_repeat(F.lit("0"), SEGMENTS)), F.lit(1), F.greatest(F.lit(SEGMENTS), F.size(release))), lambda s: _number(s)), ".")
    pre = F.when(part(3).isin("a", "alpha"), "a").when(part(3).isin("b", "beta"), "b").when(part(3) != "", "c")
    post = F.when(part(5) != "", _number(part(5))).when(part(6) != "", _number(part(7)))
    dev = F.when(part(8) != "", _number(part(9)))
    stage = F.when(pre.isNull() & post.isNull() & dev.isNotNull(), F.lit("0")).when(pre.isNotNull(), F.concat(F.lit("1"), pre, _number(part(4)))).otherwise(F.lit("2"))
    return F.concat_ws("|", _number(part(1)), padded, stage, F.coalesce(F.concat(F.lit("1"), post), F.lit("0")), F.coalesce(F.concat(F.lit("0"), dev), F.lit("1")))


def _local(p: Column) -> Column:
    words = F.transform(F.split(F.element_at(p, 10), "[-_.]"), lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("1"), _number(s))).otherwise(F.concat(F.lit("0"), s)))
    return F.when(F.element_at(p, 10) == "", F.lit("")).otherwise(F.array_join(words, "."))


def sort_key(text: Column) -> Column:
    """A string whose byte order is version order; null if the text is no version.

    1.0 and 1.0.0 have one key. Order within a release: dev, alpha, beta,
    candidate, final, post; a local part comes after none, numbers after words.
    """
    return let(_parts(text), lambda p: F.when(F.size(p) == 10, F.concat_ws("|", _public(p), _local(p))))


def is_prerelease(text: Column) -> Column:
    """Whether a version is a pre-release or a development one."""
    return (F.regexp_extract(text, GRAMMAR, 3) != "") | (F.regexp_extract(text, GRAMMAR, 8) != "")


@arrow_udf(BooleanType())
def satisfies(version: pa.Array, clause: pa.Array) -> pa.Array:
    """Whether a version meets one clause such as ``>=1.2``.

    < and > are plain order. == and != leave a local part aside unless the clause
    has one, and compare text where its target is no version. A ``.*`` target
    asks for the same epoch and a release that starts alike. ~= asks for two
    segments or more, a version not below the target, and a release that starts
    as the target without its last segment does, in epoch 0. No other clause is
    met by a target that is no version. Null for a version that is none, but for
    ===, which compares text, and for a text without an operator.

    Each version and clause is read once a task, as long as not too many others
    come between: as expressions a check took a quarter of a millisecond.
    """
    return pa.array(list(map(_met, version.to_pylist(), clause.to_pylist())), pa.bool_())


@arrow_udf(BooleanType())
def satisfies_all(version: pa.Array, clauses: pa.Array) -> pa.Array:
    """All of an array of clauses; none is met by any version, and null where there is no array."""
    return pa.array([None if cs is None else all(_met(v, c) for c in cs) for v, cs in zip(version.to_pylist(), clauses.to_pylist())], pa.bool_())


def requirement(text: Column) -> Column:
    """struct(name, extras, clauses, marker) of a requirement line; null for one with a direct reference."""
    body, marker = F.trim(F.split(text, ";", 2)[0]), F.trim(F.try_element_at(F.split(text, ";", 2), F.lit(2)))
    name = F.regexp_extract(body, r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1)
    extras = F.regexp_extract(body, r"\[([^\]]*)\]", 1)
    spec = F.regexp_replace(F.regexp_replace(body, r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?\s*(\[[^\]]*\])?\s*", ""), r"[()]", "")
    listed = lambda s: F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
    fine = (name != "") & ~body.contains("@")
    return F.when(fine, F.struct(F.regexp_replace(F.lower(name), "[-_.]+", "-").alias("name"), listed(extras).alias("extras"), listed(spec).alias("clauses"), F.nullif(marker, F.lit("")).alias("marker")))


_TOKEN = re.compile(r"\s*(?:(\()|(\))|('[^']*'|\"[^\"]*\")|(===|~=|==|!=|<=|>=|<|>)|(not\s+in\b|in\b|and\b|or\b)|([A-Za-z_][A-Za-z0-9_.]*))")
_VERSIONED = {"python_version", "python_full_version", "implementation_version"}


def read_marker(marker: str | None, variable: Callable, compare: Callable, both: Callable, either: Callable, true, literal: Callable):
    """Reads a marker and puts it together with the given parts, whatever they make: expressions or truth values.

    ``compare`` gets both sides, the operator, and whether a variable that holds a
    version is among them. Text that is no marker raises ``ValueError``.
    """
    if not marker or not marker.strip():
        return true
    tokens, at = [], 0
    text = marker.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a marker at {text[at:]!r}")
        tokens.append((m.lastindex, m.group(m.lastindex)))
        at = m.end()
    place = 0

    def peek() -> tuple[int, str] | tuple[None, None]:
        return tokens[place] if place < len(tokens) else (None, None)

    def take() -> tuple[int, str]:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the marker ends too soon")
        place += 1
        return tokens[place - 1]

    def operand():
        kind, word = take()
        if kind == 3:
            return literal(word[1:-1]), None
        if kind == 6:
            return variable(word), word
        raise ValueError(f"{word!r} is no value")

    def comparison():
        kind, _ = peek()
        if kind == 1:
            take()
            inside = alternatives()
            if take()[0] != 2:
                raise ValueError("a bracket is not closed")
            return inside
        left, left_name = operand()
        kind, op = take()
        right, right_name = operand()
        if kind not in (4, 5):
            raise ValueError(f"{op!r} does not compare")
        return compare(left, re.sub(r"\s+", " ", op), right, bool(_VERSIONED & {left_name, right_name}))

    def conjunction():
        out = comparison()
        while peek() == (5, "and"):
            take()
            out = both(out, comparison())
        return out

    def alternatives():
        out = conjunction()
        while peek() == (5, "or"):
            take()
            out = either(out, conjunction())
        return out

    result = alternatives()
    if place != len(tokens):
        raise ValueError(f"{tokens[place][1]!r} was not expected")
    return result


def marker_column(marker: str | None, environment: dict[str, Column]) -> Column:
    """An environment marker, read here and turned into a boolean expression.

    ``environment`` names the columns that stand for its variables. A variable
    that is not among them makes its comparison false. No marker is true; text
    that is no marker raises ``ValueError``.
    """

    def compare(left: Column | None, op: str, right: Column | None, versioned: bool) -> Column:
        if left is None or right is None:
            return F.lit(False)
        if op in ("in", "not in"):
            inside = F.contains(right, left)
            return ~inside if op == "not in" else inside
        if versioned:
            return F.coalesce(satisfies(left, F.concat(F.lit(op), right)), F.lit(False))
        plain = {"==": left == right, "===": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
        return F.coalesce(plain.get(op, F.lit(False)), F.lit(False))

    return read_marker(marker, environment.get, compare, lambda a, b: a & b, lambda a, b: a | b, F.lit(True), F.lit)


# The same rules on single values: for clauses, and for planners that follow one requirement after another.

_GRAMMAR = re.compile(GRAMMAR, re.ASCII)
_CLAUSE = re.compile(r"\s*(===|~=|==|!=|<=|>=|<|>)", re.ASCII)
_STAGES = {"a": "a", "alpha": "a", "b": "b", "beta": "b"}


@dataclass(frozen=True)
class Version:
    """A version that was read: its order with and without its local part, its epoch and its release."""

    text: str
    epoch: int
    release: tuple[int, ...]
    public: tuple
    local: tuple
    prerelease: bool

    @classmethod
    def read(cls, text: str | None) -> Version | None:
        m = _GRAMMAR.match(text or "")
        if not m:
            return None
        epoch, release, stage, number, dash, post, post_number, dev, dev_number, local = m.groups()
        parts = tuple(int(x) for x in release.split("."))
        short = parts
        while len(short) > 1 and short[-1] == 0:
            short = short[:-1]
        after = int(dash) if dash else int(post_number or 0) if post else None
        before = int(dev_number or 0) if dev else None
        if stage:
            place = (1, _STAGES.get(stage.lower(), "c"), int(number or 0))
        else:
            place = (0, "", 0) if after is None and before is not None else (2, "", 0)
        public = (int(epoch or 0), short, place, -1 if after is None else after, float("inf") if before is None else before)
        words = tuple((1, int(w), "") if w.isdigit() else (0, 0, w.lower()) for w in re.split("[-_.]", local)) if local else ()
        return cls(text.strip(), int(epoch or 0), parts, public, words, bool(stage or dev))

    @property
    def key(self) -> tuple:
        return (*self.public, self.local)


#: Versions and clauses that a process remembers.
MOST_READ = 1 << 14


@lru_cache(MOST_READ)
def _version(text: str) -> Version | None:
    try:
        return Version.read(text)
    except ValueError:  # a number of more digits than Python reads
        return None


@lru_cache(MOST_READ)
def _clause(clause: str) -> tuple[str, str, bool, Version | None]:
    """(operator, target, whether it ends in ``.*``, the target's version); the operator of a text without one is empty."""
    m = _CLAUSE.match(clause)
    target = clause[m.end() if m else 0 :].strip(" ")
    return m[1] if m else "", target, target.endswith(".*"), _version(target.removesuffix(".*"))


def _starts(version: Version, prefix: tuple[int, ...], epoch: int) -> bool:
    return version.epoch == epoch and (version.release + (0,) * len(prefix))[: len(prefix)] == prefix


@lru_cache(MOST_READ)
def _met(version: str | None, clause: str | None) -> bool | None:
    """``satisfies`` of one text."""
    if version is None or clause is None:
        return None
    op, text, wild, target = _clause(clause)
    if op == "===":
        return version.strip(" ") == text
    own = _version(version)
    if own is None or not op:
        return None
    if op in ("==", "!="):
        if wild:
            same = target is not None and _starts(own, target.release, target.epoch)
        elif target is None:
            same = version.strip(" ") == text
        else:
            same = own.key == target.key if target.local else own.public == target.public
        return same == (op == "==")
    if target is None or wild:
        return False
    if op == "~=":
        return len(target.release) > 1 and own.key >= target.key and _starts(own, target.release[:-1], 0)
    return {"<": own.key < target.key, "<=": own.key <= target.key, ">": own.key > target.key, ">=": own.key >= target.key}[op]


def meets(version: Version, clause: str) -> bool:
    """``satisfies`` of one read version; a text without an operator is not met."""
    return bool(_met(version.text, clause))


def read_requirement(text: str) -> tuple[str, list[str], list[str], str | None] | None:
    """``requirement`` of one line: (name, extras, clauses, marker), or null for one with a direct reference."""
    body, _, marker = text.partition(";")
    m = re.match(r"\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*(.*)$", body.strip())
    if not m or "@" in body:
        return None
    listed = lambda s: [x.strip() for x in s.split(",") if x.strip()]
    return re.sub("[-_.]+", "-", m[1].lower()), listed(m[2] or ""), listed(re.sub(r"[()]", "", m[3])), marker.strip() or None


def marker_holds(marker: str | None, environment: dict[str, str]) -> bool:
    """A marker in an environment of plain values."""

    def compare(left: str | None, op: str, right: str | None, versioned: bool) -> bool:
        if left is None or right is None:
            return False
        if op in ("in", "not in"):
            return (left in right) == (op == "in")
        if versioned:
            known = Version.read(left)
            return known is not None and meets(known, op + right)
        return {"==": left == right, "===": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}.get(op, False)

    return read_marker(marker, environment.get, compare, lambda a, b: a and b, lambda a, b: a or b, True, lambda v: v)
