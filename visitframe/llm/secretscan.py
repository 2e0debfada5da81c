"""Secrets in text: fixed forms, and strings of high sliding-window entropy.

All on the JVM. Matches get positions by marking them in the text and adding
the lengths of the pieces between the marks. Characters 1 and 2 serve as marks;
where a text holds them they are read as character 3, which no pattern knows.

Candidate strings are runs of token characters that hold a digit and a letter.
Over each candidate a window moves; the counts of its characters and the sum
of ``c * log2(c)`` are carried along, so a step costs two count changes. The
window's entropy is ``log2(width) - sum / width``. A candidate's class sets the
entropy that counts as secret. Strings of the allow list are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import let

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind to (pattern of two groups, least length of the second). A shorter assignment is a match
#: that uses up its text and is dropped; a shorter run of the others is none from the start.
FORMS = {
    "assign": (rf"""((?:{NAMES})["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"()(AKIA[A-Z0-9]{14,})", 18),
    "hex": (r"()([0-9a-f]{16,})", 16),
}
#: Character class to (pattern of the whole candidate, least entropy in bits).
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", 2.9),
    "one_case": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.4),
    "mixed": (r"^.*$", 3.7),
}
#: Strings that look random and are none: UUIDs, dates and times, version numbers, place holders.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9TZ:+/_=-]+$",
    r"^(?i)[a-z]+([-_/=][a-z]+)*[-_/=]?[0-9]{1,4}$",
    r"(?i)(example|placeholder|changeme|your[-_]?(key|token|secret)|x{6,}|abcdefgh|12345678)",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _marked(text: Column, pattern: str) -> Column:
    """Pieces of the text: plain ones at even places, matches at odd ones."""
    clean = F.translate(text, "\x01\x02", "\x03\x03")
    return F.split(F.regexp_replace(clean, pattern, "\x01$1\x02$2\x01"), "\x01", -1)


def _starts(sizes: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array, in blocks so that long arrays stay cheap."""

    def running(values: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(
            values, begin,
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
            lambda a: a["out"],
        )

    count = F.ceil(F.size(sizes) / F.lit(block)).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    inside = F.transform(blocks, running)
    return F.flatten(
        F.zip_with(inside, running(sums), lambda x, base: F.transform(x, lambda v: v + base))
    )


def _found(text: Column, kind: str, pattern: str, least: int) -> Column:
    """Array of (start, end, kind, value): matches whose second group is long enough."""

    def spans(pieces: Column) -> Column:
        # A match carries one mark inside, between its two groups.
        sizes = F.transform(
            pieces, lambda p, i: (F.length(p) - F.when(i % 2 == 1, 1).otherwise(0)).cast("long")
        )
        return let(sizes, lambda n: let(_starts(n), lambda s: matches(pieces, n, s)))

    def matches(pieces: Column, sizes: Column, starts: Column) -> Column:
        every = F.transform(
            pieces,
            lambda p, i: F.struct(
                starts[i].alias("start"), (starts[i] + sizes[i]).alias("end"), F.lit(kind).alias("kind"),
                F.when(i % 2 == 1, F.split(p, "\x02", 2)[1]).alias("value"),
            ),
        )
        return F.filter(every, lambda x: F.length(x["value"]) >= least)

    nothing = F.array().cast("array<struct<start:long,end:long,kind:string,value:string>>")
    return F.when(text.rlike(pattern), let(_marked(text, pattern), spans)).otherwise(nothing)


def _c_log_c(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def _hot_windows(value: Column, width: int, least: Column) -> Column:
    """(first, last): numbers of the first and last window of enough entropy, NULL if none.

    Counts move with the window: one character comes in, one goes out.
    """
    places = F.split(value, "")

    def code(chars: Column, i: Column) -> Column:
        return F.element_at(chars, i)

    codes = F.transform(places, lambda c: F.array_position(F.array([F.lit(x) for x in ALPHABET]), c).cast("int"))

    def walk(chars: Column) -> Column:
        begin = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )

        def move(state: Column, i: Column) -> Column:
            come = code(chars, i)
            go = F.when(i > width, code(chars, F.greatest(i - width, F.lit(1)))).otherwise(F.lit(0))
            more = F.element_at(state["counts"], come)
            fewer = F.when(go > 0, F.element_at(state["counts"], F.greatest(go, F.lit(1))))
            same = come == go
            total = F.when(same, state["sum"]).otherwise(
                state["sum"] + _c_log_c(more + 1) - _c_log_c(more)
                + F.when(go > 0, _c_log_c(fewer - 1) - _c_log_c(fewer)).otherwise(F.lit(0.0))
            )
            counts = F.when(same, state["counts"]).otherwise(
                F.transform(
                    state["counts"],
                    lambda c, k: c + F.when(k == come - 1, 1).otherwise(0) - F.when(k == go - 1, 1).otherwise(0),
                )
            )
            hot = (i >= width) & (F.log2(F.lit(float(width))) - total / width >= least)
            window = i - width
            return F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(hot & state["first"].isNull(), window).otherwise(state["first"]).alias("first"),
                F.when(hot, window).otherwise(state["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), begin, move)

    return let(codes, walk)


def _entropy(text: Column, width: int, allow: tuple[str, ...]) -> Column:
    """Spans of the hot windows of each candidate string."""
    lookahead = (
        rf"()((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{width},}}+)"
    )

    def judged(x: Column) -> Column:
        value = x["value"]
        kinds = F.lit(None).cast("double")
        for pattern, least in reversed(list(CLASSES.values())):
            kinds = F.when(value.rlike(pattern), F.lit(least)).otherwise(kinds)
        hot = _hot_windows(value, width, kinds)
        return let(
            hot,
            lambda h: F.struct(
                (x["start"] + h["first"]).alias("start"), (x["start"] + h["last"] + width).alias("end"),
                x["kind"].alias("kind"), value.alias("value"),
            ),
        )

    def allowed(value: Column) -> Column:
        out = F.lit(False)
        for pattern in allow:
            out = out | value.rlike(pattern)
        return out

    found = F.filter(_found(text, "entropy", lookahead, width), lambda x: ~allowed(x["value"]))
    return F.filter(F.transform(found, judged), lambda x: x["start"].isNotNull())


SPANS = "array<struct<start:long,end:long,kind:string>>"


def find_secrets(text: Column, width: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> Column:
    """Array of (start, end, kind), by start and then in the order of KINDS.

    Positions count code points, the end is exclusive. NULL and empty texts
    give an empty array. Of each kind matches are leftmost and do not overlap;
    different kinds may overlap and all are told.
    """
    safe = F.coalesce(text, F.lit(""))
    parts = [_found(safe, kind, pattern, least) for kind, (pattern, least) in FORMS.items()]
    parts.append(_entropy(safe, width, allow))
    rank = F.create_map(*[F.lit(v) for k, name in enumerate(KINDS) for v in (name, k)])
    keyed = F.transform(
        F.concat(*parts),
        lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("k"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, secrets): a row for each row, in one pass without a shuffle."""
    return docs.select(F.col(id_col), find_secrets(F.col(text_col), width, allow).alias("secrets"))


def redacted(text: Column, spans: Column, label: str = "[SECRET]") -> Column:
    """The text with each group of overlapping spans replaced by ``label``; NULL stays NULL."""
    begin = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("any")
    )

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        fresh = ~a["any"] | (x["start"] >= a["at"])
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(a["out"], F.array(gap, F.lit(label)))).otherwise(a["out"]).alias("out"),
            F.lit(True).alias("any"),
        )

    def close(a: Column) -> Column:
        rest = F.substring(text, (a["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(a["out"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, close)).otherwise(text)
