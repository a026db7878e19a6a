"""Best representative of each duplicate group: whole bundles of dependent fields, chosen by branch and bound.

A bundle is a set of fields that must come from one row (a vector with its scale, the parts of an attribution). Within a group every bundle has
its candidates in order of trust; taking the n-th candidate costs n, leaving the bundle out costs as many as there are candidates. A
functional dependency (determinant -> bundles) says that the chosen rows of those bundles must agree in the determinant. The search picks the
cheapest consistent choice.

Only candidates that can win reach the search: of the rows with equal determinant the most trusted one (a less trusted row with the same
determinant can replace no other). That is an aggregation with map-side combine: a group of any size arrives with one candidate a bundle without
dependencies, else one a value of the determinants. So a determinant must have few values in a group (a features version has); every bundle,
tied or not, is chosen by the search, and sets of bundles that share no dependency are searched apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stand-ins for "no album", folded to lower case and trimmed.
NO_ALBUM = ("", "-", "--", "n/a", "na", "none", "null", "unknown", "unknown album", "[no album]", "no album", "[unknown]", "untitled album", "?")
# Fixed value: an address of a picture whose name is empty.
NO_PICTURE = r"/cover//|/cover/?$"


@dataclass(frozen=True)
class Bundle:
    name: str
    filled: Column
    #: Names of the dependencies whose determinant the chosen row fixes.
    agrees: tuple[str, ...] = field(default=())


def _together(agrees: list[tuple[int, ...]]) -> list[list[int]]:
    """Bundles in sets that share no dependency with each other: each set is a search of its own."""
    sets: list[tuple[set[int], list[int]]] = []
    for b, mine in enumerate(agrees):
        touched = [s for s in sets if s[0] & set(mine)]
        sets = [s for s in sets if s not in touched]
        sets.append((set(mine).union(*(s[0] for s in touched)), sorted([b, *(x for s in touched for x in s[1])])))
    return [bundles for _, bundles in sets]


def search(costs: list[list[tuple]], agrees: list[tuple[int, ...]], n: int) -> list[int]:
    """Branch and bound. costs[b]: the candidates of bundle b in order of trust, each with its determinants (one a dependency, only those in
    agrees[b] count). Returns the chosen index of each bundle, or -1 for none. Of equally cheap choices the first in lexicographic order wins.

    The bound of a branch is what is spent and, for each bundle to come, the first candidate that agrees with what is fixed so far: no choice
    below the branch can cost less."""
    chosen = [-1] * len(costs)
    for bundles in _together(agrees):
        picks = _branch([costs[b] for b in bundles], [agrees[b] for b in bundles], n)
        for b, i in zip(bundles, picks):
            chosen[b] = i
    return chosen


def _branch(costs: list[list[tuple]], agrees: list[tuple[int, ...]], n: int) -> list[int]:
    total, best_cost, best = len(costs), float("inf"), [-1] * len(costs)
    chosen, fixed = [-1] * total, [None] * n

    def allowed(b: int, i: int) -> bool:
        return all(fixed[d] is None or fixed[d] == (costs[b][i][d],) for d in agrees[b])

    def ahead(k: int) -> int:
        return sum(next((i for i in range(len(costs[b])) if allowed(b, i)), len(costs[b])) for b in range(k, total))

    def visit(k: int, spent: int) -> None:
        nonlocal best_cost, best
        if k == total:
            if spent < best_cost:
                best_cost, best = spent, chosen.copy()
            return
        for i in [*range(len(costs[k])), -1]:
            cost = len(costs[k]) if i < 0 else i
            if spent + cost >= best_cost:
                continue
            if i >= 0 and not allowed(k, i):
                continue
            before = fixed.copy()
            if i >= 0:
                for d in agrees[k]:
                    fixed[d] = (costs[k][i][d],)
            chosen[k] = i
            if spent + cost + ahead(k + 1) < best_cost:
                visit(k + 1, spent + cost)
            fixed[:] = before
        chosen[k] = -1

    visit(0, 0)
    return best


def best_representatives(rows: DataFrame, group: str, rid: str, trust: list[Column], bundles: list[Bundle], dependencies: dict[str, Column] | None = None) -> DataFrame:
    """(group, bundle, rid): the row that supplies each bundle of each group.

    trust: columns in falling weight, greater is better, null lowest; ties go to the smallest rid. A bundle that no row fills is absent from the
    result, as is one that no consistent choice can fill. Defined cases: rows with a null group or rid are ignored; repeated rows count once (they
    are equal candidates); NaN trust counts above every number, as Spark orders it; an empty table gives no rows; other columns are ignored.
    """
    dependencies = dependencies or {}
    names = list(dependencies)
    order = []
    for t in trust:
        order += [t.isNull(), -t]
    tried = rows.filter(F.col(group).isNotNull() & F.col(rid).isNotNull()).select(
        F.col(group).alias("_g"),
        F.col(rid).alias("_r"),
        F.struct(*[x.alias(f"t{i}") for i, x in enumerate(order)], F.col(rid).alias("r")).alias("_o"),
        *[d.cast("string").alias(f"_d{i}") for i, d in enumerate(dependencies.values())],
        *[b.filled.alias(f"_f{i}") for i, b in enumerate(bundles)],
    )
    keys = [f"_d{i}" for i in range(len(names))]
    # The most trusted row of each bundle, by group and determinants: one aggregation, combined before its shuffle.
    best = tried.groupBy("_g", *keys).agg(*[F.min(F.when(F.col(f"_f{i}"), F.col("_o"))).alias(f"_b{i}") for i in range(len(bundles))])
    lists = [F.filter(F.array_sort(F.collect_list(F.struct(F.col(f"_b{i}").alias("o"), F.array(*[F.col(k) for k in keys]).cast("array<string>").alias("d")))), lambda x: x["o"].isNotNull()) for i in range(len(bundles))]
    listed = best.groupBy("_g").agg(*[F.transform(x, lambda y: F.struct(y["o"]["r"].cast("string").alias("r"), y["d"].alias("d"))).alias(f"_c{i}") for i, x in enumerate(lists)])
    agrees = [tuple(names.index(a) for a in b.agrees) for b in bundles]
    titles, total = [b.name for b in bundles], len(bundles)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, fields, ids = [], [], []
            columns = [batch.column(1 + b).to_pylist() for b in range(total)]
            for k, g in enumerate(batch.column(0).to_pylist()):
                lists = [columns[b][k] for b in range(total)]
                picks = search([[tuple(c["d"]) for c in x] for x in lists], agrees, len(names))
                for b, i in enumerate(picks):
                    if i >= 0:
                        groups.append(g)
                        fields.append(titles[b])
                        ids.append(lists[b][i]["r"])
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(fields, pa.string()), pa.array(ids, pa.string())], ["group_id", "field", "row_id"])

    out = listed.withColumn("_g", F.col("_g").cast("string")).mapInArrow(solve, "group_id string, field string, row_id string")
    return out.select(F.col("group_id").alias(group), F.col("field"), F.col("row_id").alias(rid))


def _some(parts: list[str], struct: str) -> Column:
    out = F.col(struct)[parts[0]].isNotNull()
    for p in parts[1:]:
        out |= F.col(struct)[p].isNotNull()
    return F.col(struct).isNotNull() & out


def _text(name: str) -> Column:
    """Lower case, white space of any kind off both ends."""
    return F.lower(F.regexp_replace(F.col(name), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def track_bundles(agree: bool = False) -> list[Bundle]:
    """The bundles of a stored track. With agree, what one analysis made (vector, feel, rhythm) must come from one features version."""
    made = ("analysis",) if agree else ()
    rhythm = ["tempo_bpm", "beat_strength", "loudness_lufs", "loudness_range", "key", "mode", "key_strength"]
    return [
        Bundle("album", F.coalesce(~_text("album").isin(*NO_ALBUM), F.lit(False))),
        Bundle("artwork_url", F.coalesce((_text("artwork_url") != "") & ~F.col("artwork_url").rlike(NO_PICTURE) & ~_text("artwork_url").isin("-", "n/a", "none", "null", "unknown"), F.lit(False))),
        Bundle("attribution", _some(["source", "url", "license"], "attribution")),
        Bundle("embedding", F.coalesce((F.octet_length("embedding") > 0) & ~F.hex("embedding").rlike("^0*$"), F.lit(False)), made),
        Bundle("feel", F.coalesce(F.exists("feel", lambda x: x.isNotNull() & (x != 0)), F.lit(False)), made),
        Bundle("rhythm", _some(rhythm, "rhythm"), made),
    ]


def track_survivors(members: DataFrame, agree: bool = False) -> DataFrame:
    """(group_id, field, track_id) for members: the rows of tracks with their group_id."""
    trust = [F.col("features_version").cast("long"), F.unix_micros(F.col("analyzed_at").cast("timestamp"))]
    return best_representatives(members, "group_id", "track_id", trust, track_bundles(agree), {"analysis": F.col("features_version")} if agree else None)
