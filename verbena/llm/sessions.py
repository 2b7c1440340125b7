"""Late session merging: every version of every user's sessions, when events come in batches and late.

A user's time axis is cut into cells as long as the gap and shards of SHARD cells. Two events of one cell are always neighbours, and
events of cells that do not touch never are, so a cell is at most one island and a shard's history is bounded by the batches that touch it, not by its events.
Each shard replays its batches on its own: a version is done if its island touches neither end of the shard, as nothing outside can reach
it then. What touches an end goes up as the shard's history, a state for each batch that changed it. Neighbouring shards are stitched in
pairs, level by level: the state of both at a batch says whether the last island of one and the first of the other are one.
Stitching is associative, and histories are cut into runs of EPOCH batches, each with the states that held before it, so no
task gets the history of a whole user, however long one session lasts; what a run needs from others is looked up over blocks of blocks.

A session's version is named by the first cell that got an event in its batch. When two parts that changed in the same batch are
stitched, the right name becomes an alias of the left one; versions learn by that name what retracts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import release, ship, written

#: Cells of a shard, and batches of a run of a history.
SHARD, EPOCH = 32, 64
#: Runs whose states are looked up in one window; blocks of so many runs are one row of the next.
BLOCK = 64

_RUN = "struct<s:bigint,e:bigint,n:bigint,h:bigint,at:bigint,new:bigint,wit:bigint>"
_STATE = f"struct<b:bigint,first:{_RUN},last:{_RUN},whole:boolean>"
_VERSION = "struct<b:bigint,s:bigint,e:bigint,n:bigint,new:bigint,h:bigint,wit:bigint,rb:bigint,rw:bigint,open:string>"
_CHANGE = "struct<b:bigint,wit:bigint>"
_ALIAS = "struct<b:bigint,wit:bigint,to:bigint>"


def _version(run: dict, side: str | None = None) -> dict:
    return {"b": run["at"], **{k: run[k] for k in ("s", "e", "n", "new", "h", "wit")}, "rb": None, "rw": None, "open": side}


def replay(cells: list[dict], gap: int, first_cell: int, last_cell: int) -> tuple[list[dict], list[dict]]:
    """One shard alone: versions that are done, and the states (first, last, whole) after each batch that changed them.

    cells: batch, cell, least and greatest second, events and sum of each cell and batch.
    """
    by_batch: dict[int, list[dict]] = {}
    for c in cells:
        by_batch.setdefault(c["batch"], []).append(c)
    done: list[dict] = []
    states: list[dict] = []
    islands: list[dict] = []  # in order of time; each with the done version that stands for it, if any
    for b in sorted(by_batch):
        fresh = [{"s": c["lo"], "e": c["hi"], "n": c["n"], "h": c["h"], "at": b, "new": c["n"], "wit": c["cell"], "was": []} for c in by_batch[b]]
        merged: list[dict] = []
        for x in sorted([*({**i, "new": i["new"] if i["at"] == b else 0, "was": [i]} for i in islands), *fresh], key=lambda x: x["s"]):
            if merged and x["s"] - merged[-1]["e"] <= gap:
                a = merged[-1]
                # islands keep their batch unless an event of this one joins them
                wits = [y["wit"] for y in (a, x) if y["at"] == b]
                merged[-1] = {"s": a["s"], "e": max(a["e"], x["e"]), "n": a["n"] + x["n"], "h": a["h"] + x["h"], "at": max(a["at"], x["at"]), "new": sum(y["new"] for y in (a, x) if y["at"] == b), "wit": min(wits), "was": a["was"] + x["was"]}
            else:
                merged.append(x)
        islands = []
        for x in merged:
            if x["at"] != b:
                islands.append(x["was"][0])
                continue
            for old in x["was"]:
                if old.get("done"):
                    old["done"] |= {"rb": b, "rw": x["wit"]}
            run = {k: x[k] for k in ("s", "e", "n", "h", "at", "new", "wit")}
            if run["s"] // gap != first_cell and run["e"] // gap != last_cell:
                run["done"] = _version(run)
                done.append(run["done"])
            islands.append(run)
        plain = lambda r: {k: v for k, v in r.items() if k != "done"}
        first = plain(islands[0]) if islands[0]["s"] // gap == first_cell else None
        last = plain(islands[-1]) if islands[-1]["e"] // gap == last_cell else None
        if (first and first["at"] == b) or (last and last["at"] == b):
            states.append({"b": b, "first": first, "last": last, "whole": bool(first and last and len(islands) == 1)})
    return done, states


def _joined(a: dict, c: dict) -> dict:
    at = max(a["at"], c["at"])
    parts = [x for x in (a, c) if x["at"] == at]
    return {"s": a["s"], "e": c["e"], "n": a["n"] + c["n"], "h": a["h"] + c["h"], "at": at, "new": sum(x["new"] for x in parts), "wit": min(x["wit"] for x in parts)}


_NONE = {"first": None, "last": None, "whole": False}


def stitch(left: list[dict], right: list[dict], before_left: dict | None, before_right: dict | None, gap: int) -> dict:
    """One run of batches of two neighbours: their common states, versions that are done, aliases, and the first change of the islands at the seam.

    The island at the seam is y on the left and z on the right; both are the same once they are linked. A version of y or z that no
    later change in this run retracts is open.
    """
    state = [before_left or _NONE, before_right or _NONE]
    done: list[dict] = []
    states: list[dict] = []
    aliases: list[dict] = []
    heads: dict[str, dict | None] = {"y": None, "z": None}
    standing: dict[str, dict | None] = {"y": None, "z": None}
    changes: dict[int, list[dict | None]] = {}
    for side, own in enumerate((left, right)):
        for s in own:
            changes.setdefault(s["b"], [None, None])[side] = s
    for b in sorted(changes):
        state = [new or old for new, old in zip(changes[b], state, strict=True)]
        at_left, at_right = state
        a, c = at_left["last"], at_right["first"]
        linked = bool(a and c and c["s"] - a["e"] <= gap)
        one = _joined(a, c) if linked else None
        if linked and a["at"] == b == c["at"]:
            aliases.append({"b": b, "wit": c["wit"], "to": a["wit"]})
        seam = {"y": one or a, "z": one or c}
        for k, run in seam.items():
            if run and run["at"] == b:
                heads[k] = heads[k] or {"b": b, "wit": run["wit"]}
                if standing[k]:
                    standing[k] |= {"rb": b, "rw": run["wit"], "open": None}
                    standing[k] = None
        if linked:
            if one["at"] == b and not at_left["whole"] and not at_right["whole"]:
                done.append(_version(one, "y"))
                standing["y"] = standing["z"] = done[-1]
        else:
            if a and a["at"] == b and not at_left["whole"]:
                done.append(_version(a, "y"))
                standing["y"] = done[-1]
            if c and c["at"] == b and not at_right["whole"]:
                done.append(_version(c, "z"))
                standing["z"] = done[-1]
        now = {
            "b": b, "first": one if linked and at_left["whole"] else at_left["first"], "last": one if linked and at_right["whole"] else at_right["last"],
            "whole": bool(linked and at_left["whole"] and at_right["whole"]),
        }
        if any(r and r["at"] == b for r in (now["first"], now["last"])):
            states.append(now)
    return {"states": states, "done": done, "aliases": aliases, **{f"head_{k}": v for k, v in heads.items()}}


def flush(states: list[dict]) -> dict:
    """One run of the states of a user's whole axis: nothing can reach its ends, so all versions are done."""
    done: list[dict] = []
    heads: dict[str, dict | None] = {"y": None, "z": None}
    standing: dict[str, dict | None] = {"y": None, "z": None}
    for state in states:
        b = state["b"]
        for k, run in (("y", state["first"]), ("z", state["last"])):
            if run and run["at"] == b:
                heads[k] = heads[k] or {"b": b, "wit": run["wit"]}
                if standing[k]:
                    standing[k] |= {"rb": b, "rw": run["wit"], "open": None}
                    standing[k] = None
                if k == "y" or not state["whole"]:
                    done.append(_version(run, k))
                    standing[k] = done[-1]
        if state["whole"]:
            standing["z"] = standing["y"]
    return {"states": [], "done": done, "aliases": [], **{f"head_{k}": v for k, v in heads.items()}}


def _mapped(df: DataFrame, fields: str, work: Callable[[dict], dict], most: int = 512) -> DataFrame:
    """df's rows through work, so many at a time, in any order."""
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                yield pa.RecordBatch.from_pylist([work(r) for r in batch.slice(at, most).to_pylist()], schema=schema)

    return df.mapInArrow(rows, fields)


def _nearest(df: DataFrame, keys: list[str], values: dict[str, Column], back: bool) -> DataFrame:
    """df with a column for each of values: the last one that is not null in a row of smaller epoch, or the first of a larger.

    Windows run over blocks of BLOCK epochs and then over the blocks.
    """
    over = lambda *by: Window.partitionBy(*keys, *by[:-1]).orderBy(F.col(by[-1]) if back else F.desc(by[-1])).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.max_by if back else F.min_by
    own = df.withColumns({"block": F.floor(F.col("epoch") / BLOCK), **{f"own_{k}": v for k, v in values.items()}})
    ends = own.groupBy(*keys, "block").agg(*(pick(f"own_{k}", F.when(F.col(f"own_{k}").isNotNull(), F.col("epoch"))).alias(k) for k in values))
    far = ends.select(*keys, "block", *(F.last(k, True).over(over("block")).alias(f"far_{k}") for k in values))
    near = own.withColumns({k: F.last(f"own_{k}", True).over(over("block", "epoch")) for k in values})
    return near.join(far, [*keys, "block"]).select(*df.columns, *(F.coalesce(k, f"far_{k}").alias(k) for k in values))


def _settled(done: DataFrame, keys: list[str]) -> DataFrame:
    """user, v: versions, the open ones retracted by the first change in a later run."""
    runs = _nearest(done.select(*keys, "epoch", "done", "head_y", "head_z"), keys, {"next_y": F.col("head_y"), "next_z": F.col("head_z")}, back=False)
    v = runs.select("user", F.explode("done").alias("v"), "next_y", "next_z")
    later = F.when(F.col("v.open") == "y", F.col("next_y")).when(F.col("v.open") == "z", F.col("next_z"))
    v = v.withColumn("later", later)
    return v.select("user", F.col("v").withField("rb", F.coalesce("v.rb", "later.b")).withField("rw", F.coalesce("v.rw", "later.wit")).alias("v"))


def session_versions(events: DataFrame, user: str = "user", second: str = "second", batch: str = "batch", value: str = "value", gap: int = 600, width: int = SHARD, epoch: int = EPOCH) -> DataFrame:
    """user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum, retracted_batch, retracted_start_s: a row for each version of a session.

    After each batch the events so far form sessions, whose neighbours are at most gap seconds apart; a session that holds an event of
    the batch is a new version and retracts the versions that stood for its parts. h_sum is the sum of value. Seconds are whole numbers.
    Events without a user, a second or a batch are none; a null value counts 0; repeated rows are events of their own; an empty table has no versions.
    Other columns are ignored, whatever their names. Texts play no part. width and epoch: cells of a shard and batches of a run, which change no row.
    """
    spark = events.sparkSession
    ship(spark)
    e = events.select(F.col(user).alias("user"), F.col(second).cast("long").alias("second"), F.col(batch).cast("long").alias("batch"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("value"))
    kind = e.schema["user"].dataType.simpleString()
    cell = F.expr(f"(second - pmod(second, {gap})) div {gap}")
    cells = e.dropna(subset=["user", "second", "batch"]).groupBy("user", cell.alias("cell"), "batch").agg(F.min("second").alias("lo"), F.max("second").alias("hi"), F.count("*").alias("n"), F.sum("value").alias("h"))
    shard = F.expr(f"(cell - pmod(cell, {width})) div {width}")
    shards = cells.groupBy("user", shard.alias("shard")).agg(F.collect_list(F.struct("batch", "cell", "lo", "hi", "n", "h")).alias("cells"))
    leaf = _mapped(shards, f"user {kind}, shard bigint, done array<{_VERSION}>, states array<{_STATE}>", lambda r: _leaf(r, gap, width))
    leaf = written(leaf, "session-shards")
    spans = leaf.groupBy("user").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
    depth = F.when(F.col("high") == F.col("low"), 0).otherwise(F.floor(F.log2((F.col("high") - F.col("low")).cast("double"))) + 1).cast("int")
    state = leaf.where(F.size("states") > 0).select("user", "shard", F.explode("states").alias("state"))
    runs = state.groupBy("user", "shard", F.expr(f"(state.b - pmod(state.b, {epoch})) div {epoch}").alias("epoch")).agg(F.sort_array(F.collect_list("state")).alias("states"))
    nodes = runs.join(spans.select("user", "low", depth.alias("depth")), "user").select("user", "depth", (F.col("shard") - F.col("low")).alias("node"), "epoch", "states")
    nodes = written(nodes, "session-runs")
    # the number of levels, a logarithm of the longest axis, is all that the driver learns
    deepest = nodes.agg(F.max("depth")).first()[0]
    found = [leaf.select("user", F.explode("done").alias("v"))]
    links: list[DataFrame] = []
    held = [leaf, nodes]
    fields = f"user {kind}, depth int, node bigint, epoch bigint, states array<{_STATE}>, done array<{_VERSION}>, aliases array<{_ALIAS}>, head_y {_CHANGE}, head_z {_CHANGE}"
    for level in range((deepest if deepest is not None else -1) + 1):
        over = written(_mapped(nodes.where(F.col("depth") == level), fields, lambda r: r | flush(r["states"])), "session-ends")
        held.append(over)
        found.append(_settled(over, ["user", "node"]))
        below = nodes.where(F.col("depth") > level)
        if level == deepest:
            break
        side = F.col("node") % 2
        pairs = below.groupBy("user", "depth", F.expr("node div 2").alias("node"), "epoch").agg(F.first(F.when(side == 0, F.col("states")), True).alias("l"), F.first(F.when(side == 1, F.col("states")), True).alias("r"))
        pairs = _nearest(pairs, ["user", "node"], {f"before_{c}": F.when(F.col(c).isNotNull(), F.element_at(c, -1)) for c in ("l", "r")}, back=True)
        up = written(_mapped(pairs, fields, lambda r: _pair(r, gap)), "session-runs")
        held.append(up)
        found.append(_settled(up, ["user", "node"]))
        links.append(up.select("user", F.explode("aliases").alias("a")).select("user", F.col("a.b").alias("b"), F.col("a.wit").alias("wit"), F.col("a.to").alias("to")))
        nodes = up.where(F.size("states") > 0).select("user", "depth", "node", "epoch", "states")
    versions = found[0]
    for f in found[1:]:
        versions = versions.unionByName(f)
    versions = written(versions.select("user", "v.*"), "session-versions")
    names = versions.where("rb IS NOT NULL").select("user", F.col("rb").alias("b"), F.col("rw").alias("wit")).distinct()
    roots = _roots(names, links)
    starts = versions.select("user", "b", F.col("wit").alias("root"), F.col("s").alias("retracted_start_s"))
    ends = roots.join(starts, ["user", "b", "root"]).select("user", F.col("b").alias("rb"), F.col("wit").alias("rw"), "root", "retracted_start_s")
    told = versions.join(ends, ["user", "rb", "rw"], "left")
    counts = told.where("rb IS NOT NULL").groupBy("user", F.col("rb").alias("b"), F.col("root").alias("wit")).agg(F.count("*").alias("n_retracted"))
    out = told.drop("root").join(counts, ["user", "b", "wit"], "left").select(
        "user", F.col("b").alias("batch"), F.col("s").alias("start_s"), F.col("e").alias("end_s"), F.col("n").alias("n_events"), F.col("new").alias("n_new"),
        F.coalesce("n_retracted", F.lit(0)).cast("long").alias("n_retracted"), F.col("h").alias("h_sum"), F.col("rb").alias("retracted_batch"), "retracted_start_s",
    )
    out = written(out, "sessions")
    release(*held, versions)
    return out


def _leaf(r: dict, gap: int, width: int) -> dict:
    done, states = replay(r["cells"], gap, r["shard"] * width, r["shard"] * width + width - 1)
    return {"user": r["user"], "shard": r["shard"], "done": done, "states": states}


def _pair(r: dict, gap: int) -> dict:
    return {k: r[k] for k in ("user", "depth", "node", "epoch")} | stitch(r["l"] or [], r["r"] or [], r["before_l"], r["before_r"], gap)


def _roots(names: DataFrame, links: list[DataFrame]) -> DataFrame:
    """user, b, wit, root: the name that stands for wit after all aliases; from the lowest level up, an alias of each level at most."""
    roots = names.withColumn("root", F.col("wit"))
    for level in links:
        to = level.select("user", "b", F.col("wit").alias("root"), "to")
        roots = roots.join(to, ["user", "b", "root"], "left").select("user", "b", "wit", F.coalesce("to", "root").alias("root"))
    return roots
