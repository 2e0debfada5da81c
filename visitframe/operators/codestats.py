"""Code, pair, triple and sequential-pair probabilities of visits.

``codes`` is a long table (seq, visit_idx, pos, code), ``visits`` one row per
visit (seq, visit_idx) so that visits without codes count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import ratio
from visitframe.functions.ordered import block_of, by_size, dealt, union_all
from visitframe.operators.restructure import all_keys

VISIT = ["seq", "visit_idx"]
PAIR = ["first", "second"]
TRIPLE = ["first", "second", "third"]
BLOCK = 64
FAMILY_KEYS = ["family", "k1", "k2", "k3"]


def _in_blocks(codes: DataFrame, width: int) -> DataFrame:
    """Codes of each run of at most ``width`` positions as one ordered array, dealt by record."""
    item = F.struct("pos", "code")
    packed = dealt(codes, ["seq"]).groupBy(*VISIT, block_of("pos", width).alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("_x")
    )
    return packed.withColumn("_x", F.transform("_x", lambda x: x["code"]))


def _rest(items: Column | str, i: Column) -> Column:
    return F.slice(items, i + 2, F.size(items))


def _levels(codes: DataFrame, width: int) -> int:
    """How often the block width must double to cover the longest visit."""
    last = codes.agg(F.max(block_of("pos", width))).first()[0] or 0
    return int(last).bit_length()


def _histogram(codes: DataFrame, width: int) -> DataFrame:
    return codes.groupBy(*VISIT, block_of("pos", width).alias("block"), "code").agg(
        F.count("*").alias("n")
    )


def _halves(left: DataFrame, right: DataFrame, keep: list[Column]) -> DataFrame:
    """Join each even block with the odd block after it; counts multiply."""
    parent = F.floor(F.col("block") / 2)
    a = left.where(F.col("block") % 2 == 0).withColumn("parent", parent).drop("block")
    b = right.where(F.col("block") % 2 == 1).withColumn("parent", parent).drop("block")
    return a.join(b, [*VISIT, "parent"]).select(
        *VISIT, F.col("parent").alias("block"), *keep, (F.col("n") * F.col("m")).alias("n")
    )


def _pair_levels(codes: DataFrame, width: int, levels: int) -> list[DataFrame]:
    """Pair rows by level: inside the smallest blocks, then across ever larger halves.

    A pair is emitted once, at the level where its positions part. Across
    halves only distinct codes meet, so a huge visit costs about its length
    times its number of distinct codes.
    """
    pairs = F.flatten(
        F.transform(
            "_x",
            lambda x, i: F.transform(
                _rest("_x", i), lambda y: F.struct(x.alias("first"), y.alias("second"))
            ),
        )
    )
    inside = _in_blocks(codes, width).select(*VISIT, "block", F.inline(pairs))
    out = [inside.withColumn("n", F.lit(1).cast("long"))]
    for level in range(levels):
        hist = _histogram(codes, width << level)
        out.append(
            _halves(
                hist.withColumnRenamed("code", "first"),
                hist.select(*VISIT, "block", F.col("code").alias("second"), F.col("n").alias("m")),
                [F.col("first"), F.col("second")],
            )
        )
    return out


def code_pairs(codes: DataFrame, sort: bool = False, width: int = BLOCK) -> DataFrame:
    """(seq, first, second, n): position-ordered code pairs within a visit.

    ``sort`` orders the two codes by name instead.
    """
    rows = union_all(
        [p.select("seq", *PAIR, "n") for p in _pair_levels(codes, width, _levels(codes, width))]
    )
    if sort:
        rows = rows.select(
            "seq", F.least(*PAIR).alias("first"), F.greatest(*PAIR).alias("second"), "n"
        )
    return rows


def code_triples(codes: DataFrame, width: int = BLOCK) -> DataFrame:
    """(seq, first, second, third, n): ordered code triples within a visit."""
    triples = F.flatten(
        F.flatten(
            F.transform(
                "_x",
                lambda x, i: F.transform(
                    _rest("_x", i),
                    lambda y, j: F.transform(
                        _rest("_x", i + j + 1),
                        lambda z: F.struct(
                            x.alias("first"), y.alias("second"), z.alias("third")
                        ),
                    ),
                ),
            )
        )
    )
    inside = _in_blocks(codes, width).select("seq", F.inline(triples))
    parts = [inside.withColumn("n", F.lit(1).cast("long"))]
    levels = _levels(codes, width)
    pairs = _pair_levels(codes, width, levels)
    for level in range(levels):
        hist = _histogram(codes, width << level)
        # Pairs that lie wholly inside one block of this level. Level 0 rows carry
        # the smallest block, level k rows the block of width ``width << k``.
        within = union_all(
            [
                p.withColumn("block", block_of("block", 1 << (level - made)))
                for made, p in enumerate(pairs[: level + 1])
            ]
        )
        within = within.groupBy(*VISIT, "block", *PAIR).agg(F.sum("n").alias("n"))
        one_two = _halves(
            hist.withColumnRenamed("code", "first"),
            within.select(
                *VISIT, "block", F.col("first").alias("second"), F.col("second").alias("third"),
                F.col("n").alias("m"),
            ),
            [F.col(c) for c in TRIPLE],
        )
        two_one = _halves(
            within,
            hist.select(*VISIT, "block", F.col("code").alias("third"), F.col("n").alias("m")),
            [F.col(c) for c in TRIPLE],
        )
        parts += [x.select("seq", *TRIPLE, "n") for x in (one_two, two_one)]
    return union_all(parts)


def sequential_pairs(codes: DataFrame) -> DataFrame:
    """(seq, first, second, n): codes of a visit with codes of the next one.

    Copies are counted per visit first, so only distinct codes meet. Rows are
    dealt by record once: a visit, packed, meets the one before it in a
    window. Records too large for a task are joined by visit.
    """
    return by_size(codes, ["seq"], _next_visits, _joined_visits)


def _next_visits(codes: DataFrame) -> DataFrame:
    here = codes.where(F.col("seq").isNotNull() & F.col("visit_idx").isNotNull()).repartition("seq")
    hist = here.groupBy(*VISIT, "code").agg(F.count("*").alias("n"))
    item = F.struct(F.col("code").alias("second"), F.col("n").alias("m"))
    packed = hist.groupBy(*VISIT).agg(F.collect_list(item).alias("_now"))
    along = Window.partitionBy("seq").orderBy("visit_idx")
    both = packed.select(
        *VISIT, "_now", F.lag("_now").over(along).alias("_was"), F.lag("visit_idx").over(along).alias("_last")
    ).where(F.col("_last") == F.col("visit_idx") - 1)
    before = both.select("seq", "_now", F.inline("_was").alias("first", "n"))
    return before.select("seq", "first", "n", F.inline("_now")).select(
        "seq", *PAIR, (F.col("n") * F.col("m")).alias("n")
    )


def _joined_visits(codes: DataFrame) -> DataFrame:
    hist = codes.groupBy(*VISIT, "code").agg(F.count("*").alias("n"))
    before = hist.select(
        "seq", (F.col("visit_idx") + 1).alias("visit_idx"), F.col("code").alias("first"), "n"
    )
    after = hist.select(*VISIT, F.col("code").alias("second"), F.col("n").alias("m"))
    return before.join(after, VISIT).select(
        "seq", *PAIR, (F.col("n") * F.col("m")).alias("n")
    )


def counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, records): occurrences of each key and records that contain it, together."""
    held = rows.groupBy("seq", *keys).agg(F.sum("n").alias("n"))
    return held.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("records"))


def _shares(rows: DataFrame, keys: Sequence[str], totals: Mapping[str, tuple[str, Column]], min_count: int) -> DataFrame:
    """(family, keys, n, p) of families that share their keys, from one count.

    ``totals`` gives per family the column of ``counted`` and what it is divided by.
    """
    both = counted(rows, keys)
    # Each family asks for both columns, so that one shuffle serves all.
    kept = [both.where((F.col(at) > min_count) & (F.col("n") > 0) & (F.col("records") > 0)) for at, _ in totals.values()]
    return union_all(
        [
            t.select(F.lit(name).alias("family"), *keys, F.col(at).alias("n"), ratio(F.col(at), total).alias("p"))
            for t, (name, (at, total)) in zip(kept, totals.items())
        ]
    )


def per_visit(rows: DataFrame, keys: Sequence[str], total: Column, min_count: int = 0) -> DataFrame:
    """Occurrences over ``total`` visits; keys seen at most ``min_count`` times drop."""
    counts = rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > min_count)
    return counts.select(*keys, "n", ratio(F.col("n"), total).alias("p"))


def per_record(rows: DataFrame, keys: Sequence[str], total: Column, min_count: int = 0) -> DataFrame:
    """Records that contain the key over all records."""
    counts = (
        rows.select("seq", *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    ).where(F.col("n") > min_count)
    return counts.select(*keys, "n", ratio(F.col("n"), total).alias("p"))


def visit_totals(visits: DataFrame) -> tuple[Column, Column]:
    """Number of visits and of records, as scalar subqueries."""
    records = visits.groupBy("seq").agg(F.count("*").alias("_n"))
    n_visits = records.agg(F.sum("_n")).scalar()
    return n_visits, records.agg(F.count("*")).scalar()


def code_probs(codes: DataFrame, visits: DataFrame, per: str = "visit") -> DataFrame:
    """(code, n, p) per visit (with repeats) or per record."""
    n_visits, n_records = visit_totals(visits)
    rows = codes.select("seq", "code", F.lit(1).alias("n"))
    if per == "visit":
        return per_visit(rows, ["code"], n_visits)
    if per == "record":
        return per_record(rows, ["code"], n_records)
    raise ValueError("per must be 'visit' or 'record'")


def length_stats(codes: DataFrame, visits: DataFrame) -> DataFrame:
    """Mean and population deviation of visits per record and codes per visit."""
    filled = codes.groupBy(*VISIT).agg(F.count("*").alias("_c"))
    sizes = visits.select(*VISIT).join(filled, VISIT, "left").fillna(0, ["_c"])
    by_record = sizes.groupBy("seq").agg(
        F.count("*").alias("_n"), F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_s2")
    )
    visits_n = F.sum("_n")
    mean = F.sum("_s") / visits_n
    return by_record.agg(
        F.avg("_n").alias("record_len_mean"),
        F.stddev_pop("_n").alias("record_len_std"),
        mean.alias("visit_len_mean"),
        F.sqrt(F.greatest(F.sum("_s2") / visits_n - mean * mean, F.lit(0.0))).alias("visit_len_std"),
    )


def gap_stats(gaps: DataFrame, gap: str = "gap") -> DataFrame:
    """Mean and population deviation of the gaps between rows."""
    return gaps.agg(F.avg(gap).alias("gap_mean"), F.stddev_pop(gap).alias("gap_std"))


def record_labels(stays: DataFrame) -> DataFrame:
    """(seq, label, value) of records: a label holds if any stay has it."""
    flags = stays.select(F.col("sid").alias("seq"), F.posexplode("label_phe").alias("label", "value"))
    return flags.groupBy("seq", "label").agg(F.max("value").alias("value"))


def label_probs(labels: DataFrame) -> DataFrame:
    """(label, n, p) over all records, plus the overall row."""
    per_label = labels.groupBy("label").agg(
        F.sum("value").alias("n"), F.count("*").alias("_all")
    )
    rows = per_label.select(
        F.concat(F.lit("L_"), F.col("label").cast("string")).alias("label"),
        "n",
        ratio(F.col("n"), F.col("_all")).alias("p"),
    )
    overall = per_label.agg(F.max("_all").alias("n")).select(
        F.lit("Overall").alias("label"), "n", F.lit(1.0).alias("p")
    )
    return rows.unionByName(overall)


FAMILIES = (
    "visit_code", "record_code", "visit_pair", "record_pair", "visit_triple",
    "visit_seq_pair", "record_seq_pair",
)


def code_statistics(
    codes: DataFrame,
    visits: DataFrame,
    families: Sequence[str] = FAMILIES,
    sort: bool = False,
    min_count: int = 0,
) -> DataFrame:
    """All probability families in one table (family, k1, k2, k3, n, p)."""
    n_visits, n_records = visit_totals(visits)
    n_next = n_visits - n_records
    singles = codes.select("seq", "code", F.lit(1).alias("n"))
    # Keys and rows of each kind; families by visit and by record share them.
    rows = {
        "code": (["code"], lambda both: dealt(singles, ["seq"]) if both else singles),
        "pair": (PAIR, lambda both: code_pairs(codes, sort)),
        "triple": (TRIPLE, lambda both: code_triples(codes)),
        "seq_pair": (PAIR, lambda both: sequential_pairs(codes)),
    }
    wanted = list(dict.fromkeys(families))
    parts = []
    for kind, (keys, make) in rows.items():
        by_visit, by_record = f"visit_{kind}" in wanted, f"record_{kind}" in wanted
        total = n_next if kind == "seq_pair" else n_visits
        if by_visit and by_record:
            totals = {f"visit_{kind}": ("n", total), f"record_{kind}": ("records", n_records)}
            table = _shares(make(True), keys, totals, min_count)
        elif by_visit:
            table = per_visit(make(False), keys, total, min_count).withColumn("family", F.lit(f"visit_{kind}"))
        elif by_record:
            table = per_record(make(False), keys, n_records, min_count).withColumn("family", F.lit(f"record_{kind}"))
        else:
            continue
        cells = [(F.col(keys[i]) if i < len(keys) else F.lit("")).alias(f"k{i + 1}") for i in range(3)]
        parts.append(table.select("family", *cells, "n", "p"))
    return union_all(parts)


def code_report(
    codes: DataFrame,
    visits: DataFrame,
    gaps: DataFrame | None = None,
    families: Sequence[str] = FAMILIES,
    sort: bool = True,
    min_count: int = 0,
) -> DataFrame:
    """(family, k1, k2, k3, p): the probability families with visit lengths and gaps in one table.

    The code pairs of a visit are ordered by name. Lengths and gaps are rows
    without keys: ``record_len_mean``, ``gap_std`` and the like.
    """
    blank = [F.lit("").alias(f"k{i}") for i in (1, 2, 3)]
    numbers = [length_stats(codes, visits)] + ([gap_stats(gaps)] if gaps is not None else [])
    parts = [code_statistics(codes, visits, families, sort, min_count).drop("n")]
    for row in numbers:
        cells = F.array(*[F.struct(F.lit(c).alias("family"), F.col(c).cast("double").alias("p")) for c in row.columns])
        parts.append(row.select(F.inline(cells)).select("family", *blank, "p"))
    return union_all(parts)


def r2_columns(x: Column, y: Column) -> Column:
    """R2 with ``x`` as truth; a constant truth gives 1 if met exactly, else 0."""
    residual = F.sum((x - y) * (x - y))
    total = F.var_pop(x) * F.count(x)
    return F.when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(
        1 - ratio(residual, total)
    )


#: Keys of a kind of family.
N_KEYS = {"code": 1, "pair": 2, "triple": 3, "seq_pair": 2}


def compare_code_stats(
    a: DataFrame, b: DataFrame, rare: float = 0.005, families: Sequence[str] | None = None
) -> DataFrame:
    """R2 per family over all keys (missing = 0), and over keys with ``x < rare``.

    With ``families``, those of ``code_statistics`` that the tables hold, each
    is joined by its own keys, as it was counted, and not shuffled again.
    """
    if families is None:
        joined = all_keys(a, b, FAMILY_KEYS)
    else:
        parts = []
        for name in dict.fromkeys(families):
            keys = [f"k{i + 1}" for i in range(N_KEYS[name.split("_", 1)[1]])]
            sides = [t.where(F.col("family") == name) for t in (a, b)]
            parts.append(all_keys(*sides, keys).select(F.lit(name).alias("family"), "p", "q"))
        joined = union_all(parts)
    x, y = F.col("p"), F.col("q")
    few = x < rare
    return joined.groupBy("family").agg(
        F.count("*").alias("n_keys"),
        r2_columns(x, y).alias("r2"),
        r2_columns(F.when(few, x), F.when(few, y)).alias("r2_rare"),
    )
