"""Stations as rows: bus sections, feeders, connections, switch paths and issues, for all sites at once.

terminals (site, id, kv, parent, usage), bays (site, id), switches (site, id, bay, a, b, cubicle), ends (class, id, terminal: a row
for each terminal of a piece of equipment), cubicles (id). Connectivity is structural: open switches connect as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltspan.operators.tables import free, settle

#: Most edges and starts of a group that is searched as one row.
SMALL = 4096


def sections(terminals: DataFrame, bays: DataFrame) -> DataFrame:
    """site, id, kv of the terminals that are bus sections: outside of any bay, with a usage of 0."""
    return terminals.where("usage = 0").join(bays.select(F.col("id").alias("parent")), "parent", "left_anti").select("site", "id", "kv")


def located(terminals: DataFrame, ends: DataFrame) -> DataFrame:
    """site, class, id, terminal, known, here: each piece of equipment with all its ends, for each site that one of them is in."""
    at = ends.join(terminals.select(F.col("id").alias("terminal"), "site"), "terminal", "left")
    sites = at.where("site is not null").select("class", "id", "site").distinct()
    placed = at.withColumnRenamed("site", "_site").join(sites, ["class", "id"])
    return placed.select("site", "class", "id", "terminal", F.col("_site").isNotNull().alias("known"), F.coalesce(F.col("_site") == F.col("site"), F.lit(False)).alias("here"))


def members(terminals: DataFrame, bays: DataFrame, switches: DataFrame) -> DataFrame:
    """feeder, terminal, own, n: a bay's own terminals, and the ends of its switches; n of its switches end there."""
    zero, one = F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("n")
    own = terminals.join(bays.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("feeder"), F.col("id").alias("terminal"), F.lit(True).alias("own"), zero)
    of = switches.where("bay is not null").select(F.col("bay").alias("feeder"), F.explode(F.array_distinct(F.array("a", "b"))).alias("terminal"), F.lit(False).alias("own"), one)
    return own.unionByName(of).groupBy("feeder", "terminal").agg(F.max("own").alias("own"), F.sum("n").alias("n"))


def targets(held: DataFrame, bus: DataFrame, equipment: DataFrame) -> DataFrame:
    """feeder, terminal that a feeder's paths lead to: those of its equipment; without any, its own terminal that is the only one with
    just one of its switches; else, with several sections, the last of them."""
    own = held.where("own").select("feeder", "terminal")
    attached = own.join(equipment.select("terminal").distinct(), "terminal", "left_semi")
    leaf = held.where("own and n = 1 and terminal is not null").groupBy("feeder").agg(F.count("*").alias("n"), F.min("terminal").alias("terminal")).where("n = 1")
    # A feeder's own terminals lie in a bay, so none of them is a section.
    last = held.where("not own").join(bus.select(F.col("id").alias("terminal")), "terminal", "left_semi").groupBy("feeder").agg(F.count("*").alias("n"), F.max("terminal").alias("terminal")).where("n > 1")
    first = settle(attached.select("feeder", "terminal"), "targets")
    second = leaf.join(first, "feeder", "left_anti").select("feeder", "terminal")
    third = last.join(first, "feeder", "left_anti").join(leaf, "feeder", "left_anti").select("feeder", "terminal")
    return first.unionByName(second).unionByName(third)


def searches(edges: DataFrame, starts: DataFrame, goals: DataFrame, most: int | None = None) -> DataFrame:
    """grp, label, step, via, node: for each label the shortest way from its start to a goal of its group; step 0 is the start.

    edges (grp, x, y, via), starts (grp, label, node), goals (grp, node). A label that has met a goal stops. Of equally near
    goals the least is taken, and of equally short ways the one whose last edges are least, told from the goal back. Ways of more
    than most edges don't count. Groups of up to SMALL edges and starts become one row each and are searched there; in larger
    ones all labels search at once, a level a round.
    """
    size = edges.select("grp").unionByName(starts.select("grp")).groupBy("grp").count()
    large = settle(size.where(F.col("count") > SMALL).select("grp"), "large")
    if large.isEmpty():
        return _within(edges, starts, goals, most)
    few, many = ([x.join(large, "grp", how) for x in (edges, starts, goals)] for how in ("left_anti", "left_semi"))
    return _within(*few, most).unionByName(_rounds(*many, most))


def _within(edges: DataFrame, starts: DataFrame, goals: DataFrame, most: int | None) -> DataFrame:
    """The rows of searches, each group as a row."""
    edge = F.struct("x", "y", "via")
    start, goal = F.struct("label", "node"), F.col("node")
    none = lambda rows, c: F.lit(None).cast(rows.select(c.alias("c")).schema["c"].dataType)
    parts = [(edges.where("x is not null and y is not null"), edges, edge, "e"), (starts.where("label is not null and node is not null"), starts, start, "s"), (goals.where("node is not null"), goals, goal, "g")]
    rows = [one.select("grp", *[(c if name == n else none(of, c)).alias(n) for _, of, c, n in parts]) for one, _, _, name in parts]
    packed = rows[0].unionByName(rows[1]).unionByName(rows[2]).where("grp is not null").groupBy("grp").agg(*[F.collect_list(c).alias(c) for c in "esg"])
    packed = packed.where("size(s) > 0 and size(g) > 0")
    schema = T.StructType([T.StructField("grp", edges.schema["grp"].dataType), T.StructField("label", starts.schema["label"].dataType), T.StructField("step", T.LongType()), T.StructField("via", edges.schema["via"].dataType), T.StructField("node", starts.schema["node"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            into = None
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                grp = part.column("grp")
                if into is None:
                    kinds = part.column("e").type.value_type, part.column("s").type.value_type
                    into = pa.schema([("grp", grp.type), ("label", kinds[1].field("label").type), ("step", pa.int64()), ("via", kinds[0].field("via").type), ("node", kinds[1].field("node").type)])
                found = [(g, *row) for g, e, s, goal in zip(*(part.column(c).to_pylist() for c in ("grp", "e", "s", "g")), strict=True) for row in _ways(e, s, set(goal), most)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), into, strict=True)], schema=into)

    return packed.mapInArrow(run, schema)


def _ways(edges: list[dict], starts: list[dict], goals: set, most: int | None) -> Iterator[tuple]:
    """label, step, via, node of a group's ways."""
    beside: dict = {}
    for e in edges:
        x, y, via = e["x"], e["y"], e["via"]
        order = (via is not None, via)
        beside.setdefault(x, []).append((y, (*order, x)))
        beside.setdefault(y, []).append((x, (*order, y)))
    origins: dict = {}
    for s in starts:
        origins.setdefault(s["label"], set()).add(s["node"])
    for label, front in origins.items():
        seen, step = dict.fromkeys(front), 0
        while front and not (hit := front & goals) and step != most:
            then: dict = {}
            for x in front:
                for y, last in beside.get(x, ()):
                    if y not in seen and (y not in then or last < then[y]):
                        then[y] = last
            seen.update(then)
            front, step = set(then), step + 1
        if not front or not hit:
            continue
        node = min(hit)
        while (last := seen[node]) is not None:
            yield label, step, last[1], node
            node, step = last[2], step - 1
        yield label, 0, None, node


def _rounds(edges: DataFrame, starts: DataFrame, goals: DataFrame, most: int | None) -> DataFrame:
    """The rows of searches, all labels of all groups a level a round; rounds are as many as the longest way has edges."""
    both = settle(edges.select("grp", "x", "y", "via").unionByName(edges.select("grp", F.col("y").alias("x"), F.col("x").alias("y"), "via")), "edges")
    goals = settle(goals.select("grp", "node").distinct(), "goals")
    front = settle(starts.select("grp", "label", "node", F.lit(None).cast("string").alias("via"), F.lit(None).cast(starts.schema["node"].dataType).alias("prev")), "front")
    none = front.select("grp", "label", F.lit(0).cast("long").alias("step"), "via", "node").limit(0)
    fronts, hits = [], []
    while not front.isEmpty():
        fronts.append(front)
        hits.append(settle(front.join(goals, ["grp", "node"], "left_semi").groupBy("grp", "label").agg(F.min("node").alias("node")), "hits"))
        if len(fronts) - 1 == most:
            break
        going = front.join(hits[-1].select("grp", "label"), ["grp", "label"], "left_anti").select("grp", "label", F.col("node").alias("x"))
        step = going.join(both, ["grp", "x"]).groupBy("grp", "label", F.col("y").alias("node")).agg(F.min(F.struct("via", "x")).alias("m"))
        # A node's neighbours lie in its own level, the one before or the next.
        for past in fronts[-2:]:
            step = step.join(past.select("grp", "label", "node"), ["grp", "label", "node"], "left_anti")
        front = settle(step.select("grp", "label", "node", "m.via", F.col("m.x").alias("prev")), "front")
    out, back = none, None
    for level in range(len(fronts) - 1, -1, -1):
        here = hits[level] if back is None else hits[level].unionByName(back)
        rows = settle(fronts[level].join(here, ["grp", "label", "node"]), "ways")
        part = rows.select("grp", "label", F.lit(level).cast("long").alias("step"), "via", "node")
        out = out.unionByName(part)
        back = rows.select("grp", "label", F.col("prev").alias("node"))
    free(both)
    return out


def shared(terminals: DataFrame, bays: DataFrame, switches: DataFrame, ends: DataFrame, held: DataFrame | None = None) -> dict[str, DataFrame]:
    """held and equipment, as tables: the rows of members and located that paths, feeders and issues all need. Who has the rows of
    members at hand gives them as held, with the terminals' kv if that is known as well."""
    return {"held": settle(members(terminals, bays, switches) if held is None else held, "members"), "equipment": settle(located(terminals, ends), "equipment")}


def paths(terminals: DataFrame, bays: DataFrame, switches: DataFrame, held: DataFrame, equipment: DataFrame) -> DataFrame:
    """feeder, section, step, switch, terminal: from each section that a feeder touches over its switches to a target."""
    bus = sections(terminals, bays)
    goals = targets(held, bus, equipment)
    starts = held.where("not own").join(bus.select(F.col("id").alias("terminal")), "terminal", "left_semi")
    edges = switches.where("bay is not null and a is not null and b is not null")
    found = searches(
        edges.select(F.col("bay").alias("grp"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("id").alias("via")),
        starts.select(F.col("feeder").alias("grp"), F.col("terminal").alias("label"), F.col("terminal").alias("node")),
        goals.select(F.col("feeder").alias("grp"), F.col("terminal").alias("node")),
    )
    return found.select(F.col("grp").alias("feeder"), F.col("label").alias("section"), "step", F.col("via").alias("switch"), F.col("node").alias("terminal"))


def feeders(terminals: DataFrame, bays: DataFrame, switches: DataFrame, held: DataFrame, equipment: DataFrame, ways: DataFrame) -> DataFrame:
    """site, feeder, class, kv, n_terminals, n_sections, n_switches, n_equipment, n_paths; ways are the rows of paths.

    Equipment that no bay holds is a feeder of its own. kv: of the least own terminal that has one, else of the least other one.
    """
    bus = sections(terminals, bays)
    known = held if "kv" in held.columns else held.join(terminals.select(F.col("id").alias("terminal"), "kv"), "terminal", "left")
    known = known.where("own").withColumn("bus", F.lit(None).cast("int")).unionByName(known.where("not own").join(bus.select(F.col("id").alias("terminal"), F.lit(1).alias("bus")), "terminal", "left"))
    per = known.groupBy("feeder").agg(F.count("*").cast("long").alias("n_terminals"), F.count("bus").cast("long").alias("n_sections"), F.min(F.when(F.col("kv") > 0, F.struct(~F.col("own"), "terminal", "kv"))).alias("m"))
    own = held.where("own").join(equipment.select("site", "class", "id", "terminal"), "terminal").select("feeder", "class", "id", "site").distinct()
    count = lambda rows, key, name: rows.groupBy(F.col(key).alias("feeder")).agg(F.count("*").cast("long").alias(name))
    full = bays.select("site", F.col("id").alias("feeder")).join(per, "feeder", "left")
    full = full.join(count(switches.where("bay is not null"), "bay", "n_switches"), "feeder", "left").join(count(own.select("feeder", "class", "id").distinct(), "feeder", "n_equipment"), "feeder", "left")
    full = full.join(count(ways.where("step = 0"), "feeder", "n_paths"), "feeder", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    of_bays = full.select("site", "feeder", F.lit("ElmBay").alias("class"), F.coalesce("m.kv", F.lit(0.0)).alias("kv"), *map(zero, ("n_terminals", "n_sections", "n_switches", "n_equipment", "n_paths")))
    bare = equipment.where("here").join(own.select("class", "id", "site").distinct(), ["class", "id", "site"], "left_anti").join(terminals.select(F.col("id").alias("terminal"), "kv"), "terminal").join(bus.select(F.col("id").alias("terminal"), F.lit(1).alias("bus")), "terminal", "left")
    alone = bare.groupBy("site", "class", "id").agg(F.count("*").cast("long").alias("n_terminals"), F.count("bus").cast("long").alias("n_sections"), F.coalesce(F.min_by("kv", "terminal"), F.lit(0.0)).alias("kv"))
    none = F.lit(0).cast("long")
    return of_bays.unionByName(alone.select("site", F.concat_ws("|", "class", "id").alias("feeder"), "class", "kv", "n_terminals", "n_sections", none.alias("n_switches"), F.lit(1).cast("long").alias("n_equipment"), none.alias("n_paths")))


def connections(terminals: DataFrame, switches: DataFrame, ends: DataFrame) -> DataFrame:
    """site, key, kind, terminal: the ends of each switch and each piece of equipment of a site."""
    of = switches.select("site", F.concat(F.lit("StaSwitch|"), "id").alias("key"), F.lit("switch").alias("kind"), F.explode(F.array("a", "b")).alias("terminal"))
    return of.unionByName(located(terminals, ends).select("site", F.concat_ws("|", "class", "id").alias("key"), F.lit("equipment").alias("kind"), "terminal"))


def issues(terminals: DataFrame, bays: DataFrame, switches: DataFrame, held: DataFrame, equipment: DataFrame, cubicles: DataFrame, ways: DataFrame, doubtful: DataFrame | None = None) -> DataFrame:
    """site, kind, class, id, field, reference of what a station's rows leave open; ways are the rows of paths. doubtful (site, id,
    field, reference): the switches' ends of which it isn't sure that they are terminals; without it, all are looked up."""
    known = terminals.select(F.col("id").alias("reference"))
    text = lambda x: F.lit(x)
    at = lambda field, column: switches.select("site", "id", text(field).alias("field"), F.col(column).alias("reference"))
    row = lambda rows, kind, cls: rows.select("site", text(kind).alias("kind"), (cls if cls is not None else text("StaSwitch")).alias("class"), "id", "field", "reference")
    doubtful = at("from", "a").unionByName(at("to", "b")) if doubtful is None else doubtful
    loose = row(doubtful.join(known, "reference", "left_anti"), "invalidSwitchEndpoints", None)
    lost = row(at("cubicleId", "cubicle").where("reference is not null").join(cubicles.select(F.col("id").alias("reference")), "reference", "left_anti"), "missingCubicleReferences", None)
    open_ = row(equipment.where("not known").select("site", "class", "id", text("terminal").alias("field"), F.col("terminal").alias("reference")), "unresolvedEquipmentConnections", F.col("class"))
    unclear = row(terminals.where("usage is null").join(bays.select(F.col("id").alias("parent")), "parent", "left_anti").select("site", "id", text("iUsage").alias("field"), text("").alias("reference")), "ambiguousBusSections", text("ElmTerm"))
    # A feeder without a path, a section or a terminal that two pieces of equipment share.
    joint = equipment.groupBy("site", "terminal").agg(F.count_distinct("class", "id").alias("n")).where("n > 1").select("terminal")
    fine = ways.select("feeder").unionByName(held.where("not own").join(sections(terminals, bays).select(F.col("id").alias("terminal")), "terminal", "left_semi").select("feeder")).unionByName(held.join(joint, "terminal", "left_semi").select("feeder"))
    stuck = row(bays.join(fine.select(F.col("feeder").alias("id")), "id", "left_anti").select("site", "id", text("terminalIds").alias("field"), text("").alias("reference")), "unresolvedFeederTerminals", text("ElmBay"))
    return loose.unionByName(lost).unionByName(open_).unionByName(unclear).unionByName(stuck)
