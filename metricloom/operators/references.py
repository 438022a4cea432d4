"""References between measure definitions: edges, levels, cycles, inlining.

Each step is a job over a whole catalog. Rows are identified by (model, measure_name); a name that
occurs twice in a model means its last definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.functions.text import without_comments
from metricloom.plans import settle as S

NODE = ["model", "measure_name"]

# How a measure refers to another one. A DAX reference has no word character (a table
# name), quote or closing bracket before it.
DAX_REFERENCE = r"(?<![\w'\].])\[([^\]]+)\]"
MDX_REFERENCE = r"\[Measures\]\.\[([^\]]+)\]"


# ---------------------------------------------------------------- references


def definitions(staging: DataFrame) -> DataFrame:
    """One definition per name and model: the last. A comment would swallow what follows where the text is put in, so texts
    come without. Rows are spread before they are grouped: the groups of one task are sorted in its memory."""
    last = S.spread(staging, *NODE, "position").groupBy(*NODE).agg(F.max_by("measure_expr", "position").alias("expr"), F.max_by("mode", "position").alias("mode"))
    return last.withColumn("expr", without_comments(F.col("expr")))


def measure_edges(staging: DataFrame) -> DataFrame:
    """Which known measures each measure names (B1): model, measure_name, ref."""
    return _edges(S.settle(definitions(staging)))


def _edges(defs: DataFrame) -> DataFrame:
    refs = F.when(
        F.col("mode") == "mdx", F.regexp_extract_all("expr", F.lit(MDX_REFERENCE), F.lit(1))
    ).otherwise(F.regexp_extract_all("expr", F.lit(DAX_REFERENCE), F.lit(1)))
    named = defs.select(*NODE, F.explode(F.array_distinct(refs)).alias("ref"))
    known = defs.select("model", F.col("measure_name").alias("ref"))
    return S.settle(S.salted_join(S.settle(named), known, ["model", "ref"], large=S.many(defs)).select(*NODE, "ref"))


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependency level of every node that leads to no cycle, and the edges of the others.

    Level 0 names nothing; each round finishes the nodes whose references are all finished. Every
    edge is dropped in the round its target is finished, so the work is linear in the edges. `edges`
    should be settled; each round writes the edges that are still open once.
    """
    fresh = S.settle(nodes.join(S.keyed(edges), NODE, "left_anti").select(*NODE))
    done = [fresh.withColumn("level", F.lit(0))]
    pending, level = edges, 0
    while True:
        target = fresh.select("model", F.col("measure_name").alias("ref"), F.lit(True).alias("done"))
        joined = S.salted_join(pending, target, ["model", "ref"], "left", large=S.many(fresh))
        marked, (closed, still_open) = S.settle_counting(
            joined.select(*NODE, "ref", F.col("done").isNotNull().alias("done")), F.col("done"), ~F.col("done")
        )
        pending = marked.where("NOT done").drop("done")
        if not closed:
            break
        level += 1
        fresh = S.settle(marked.groupBy(*NODE).agg(F.every("done").alias("all")).where("all").select(*NODE))
        done.append(fresh.withColumn("level", F.lit(level)))
        if not still_open:
            break
    return _union(done), pending


def levels(staging: DataFrame) -> DataFrame:
    """Dependency level, base measures first (B3). Cyclic measures and their dependants have none."""
    defs = S.settle(definitions(staging))
    return peel(defs, _edges(defs))[0]


def cycles(edges: DataFrame, peeled: bool = False) -> DataFrame:
    """Nodes that reach themselves: model, measure_name (B2).

    Nodes that lead to no cycle (gone already if the edges are `peeled`), and nodes no cycle leads
    to, are peeled off first. In what is left the strongly connected components are found by
    colouring: the greatest name that reaches a node is its colour; a component is what reaches its
    own colour backwards. Both sweeps carry one value per node, never pairs of nodes, and the length
    of their hops doubles.
    """
    loops = edges.where("measure_name = ref").select(*NODE).distinct()
    found = [S.settle(loops.withColumn("cyclic", F.lit(True)))]
    rest = S.settle(edges.where("measure_name <> ref"))
    while not rest.isEmpty():
        rest = _core(rest, peeled and not loops_only(found))
        if rest.isEmpty():
            break
        peeled = False
        colour = _colours(rest)
        members = _same_component(rest, colour)
        found.append(members)
        gone = members.select("model", F.col("measure_name").alias("__n"))
        for end in ("measure_name", "ref"):
            rest = rest.join(gone.withColumnRenamed("__n", end), ["model", end], "left_anti")
        rest = S.settle(rest.select(*NODE, "ref"))
    return _union(found).where("cyclic").select(*NODE).distinct()


def loops_only(found: list[DataFrame]) -> bool:
    """Edges from a node to itself keep nodes from being peeled, and are gone now."""
    return not found[0].isEmpty()


def _core(edges: DataFrame, peeled: bool) -> DataFrame:
    """Edges among nodes that lie between cycles: peeled from both ends."""
    forward = edges if peeled else peel(_nodes(edges), edges)[1]
    if forward.isEmpty():
        return forward
    turned = forward.select("model", F.col("ref").alias("measure_name"), F.col("measure_name").alias("ref"))
    back = peel(_nodes(turned), turned)[1]
    return back.select("model", F.col("ref").alias("measure_name"), F.col("measure_name").alias("ref"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(*NODE).unionByName(
        edges.select("model", F.col("ref").alias("measure_name"))
    ).distinct()


def _colours(edges: DataFrame) -> DataFrame:
    """Greatest name that reaches each node along the edges.

    Beside its colour a node keeps a node that reaches it, and takes that one's colour as well; the
    distance to it doubles from round to round, so long paths take few rounds.
    """
    start = edges.groupBy("model", F.col("ref").alias("measure_name")).agg(F.max("measure_name").alias("via"))
    state = S.settle(_nodes(edges).join(start, NODE, "left").select(*NODE, F.col("measure_name").alias("colour"), F.coalesce("via", "measure_name").alias("via")))
    along = edges.select("model", F.col("measure_name").alias("n"), F.col("ref").alias("to"), F.lit(False).alias("jump"))
    while True:
        known = state.select("model", F.col("measure_name").alias("n"), F.col("colour").alias("c"), F.col("via").alias("v"))
        asked = along.unionByName(state.select("model", F.col("via").alias("n"), F.col("measure_name").alias("to"), F.lit(True).alias("jump")))
        met = S.salted_join(asked, known, ["model", "n"], large=S.many(state))
        sent = met.select("model", F.col("to").alias("measure_name"), F.col("c").alias("colour"), F.when(F.col("jump"), F.col("v")).alias("via"))
        own = state.select(*NODE, "colour", F.col("colour").alias("before"))
        best = (
            own.unionByName(sent, allowMissingColumns=True)
            .groupBy(*NODE)
            .agg(F.max("colour").alias("colour"), F.max("before").alias("before"), F.max("via").alias("via"))
        )
        state, (changed,) = S.settle_counting(best, F.col("colour") != F.col("before"))
        if not changed:
            return state.select(*NODE, "colour")


def _same_component(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Nodes that reach the node their colour is named after, through their own colour."""
    near = edges.join(colour, NODE).join(
        colour.select("model", F.col("measure_name").alias("ref"), F.col("colour").alias("__c")), ["model", "ref"]
    )
    inner = S.settle(near.where("colour = __c").select(*NODE, "ref"))
    ahead = inner.groupBy(*NODE).agg(F.max("ref").alias("via"))
    state = S.settle(
        colour.join(ahead, NODE, "left").select(*NODE, (F.col("colour") == F.col("measure_name")).alias("reached"), F.coalesce("via", "measure_name").alias("via"))
    )
    along = inner.select("model", F.col("ref").alias("n"), F.col("measure_name").alias("to"), F.lit(False).alias("jump"))
    while True:
        known = state.select("model", F.col("measure_name").alias("n"), F.col("reached").alias("r"), F.col("via").alias("v"))
        asked = along.unionByName(state.select("model", F.col("via").alias("n"), F.col("measure_name").alias("to"), F.lit(True).alias("jump")))
        met = S.salted_join(asked, known, ["model", "n"], large=S.many(state)).where("r OR jump")
        sent = met.select("model", F.col("to").alias("measure_name"), F.col("r").alias("reached"), F.when(F.col("jump"), F.col("v")).alias("via"))
        own = state.select(*NODE, "reached", F.col("reached").alias("before"))
        best = (
            own.unionByName(sent, allowMissingColumns=True)
            .groupBy(*NODE)
            .agg(F.max("reached").alias("reached"), F.max("before").alias("before"), F.max("via").alias("via"))
        )
        state, (changed,) = S.settle_counting(best, F.col("reached") & ~F.col("before"))
        if not changed:
            break
    reached = state.where("reached").select(*NODE)
    # A root alone lies on a path between cycles, or is a cycle only through removed nodes.
    sizes = reached.join(colour, NODE).groupBy("model", "colour").agg((F.count(F.lit(1)) > 1).alias("cyclic"))
    return S.settle(reached.join(colour, NODE).join(sizes, ["model", "colour"]).select(*NODE, "cyclic"))


def _literal(c: Column) -> Column:
    """Escape a replacement text for regexp_replace."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _token(ref: Column, mode: Column) -> Column:
    """Pattern of the references to one measure."""
    name = F.concat(F.lit("\\Q"), ref, F.lit("\\E"))
    dax = F.concat(F.lit(r"(?<![\w'\].])\["), name, F.lit(r"\]"))
    mdx = F.concat(F.lit(r"\[Measures\]\.\["), name, F.lit(r"\]"))
    return F.when(mode == "mdx", mdx).otherwise(dax)


def _put(expr: Column, refs: Column, mode: Column) -> Column:
    """Replace every reference in an expression by its parenthesised definition."""
    return F.aggregate(refs, expr, lambda acc, r: F.regexp_replace(acc, _token(r["ref"], mode), _literal(r["text"])))


def _put_length(expr: Column, refs: Column, mode: Column) -> Column:
    """Length of the text that `_put` would make."""
    around = F.when(mode == "mdx", F.length(F.lit("[Measures].[]"))).otherwise(F.length(F.lit("[]")))

    def more(total: Column, r: Column) -> Column:
        longer = F.length(r["text"]) - F.length(r["ref"]) - around
        return total + F.regexp_count(expr, _token(r["ref"], mode)).cast("bigint") * longer.cast("bigint")

    return F.aggregate(refs, F.length(expr).cast("bigint"), more)


# Characters of an expanded text, see `expand`.
LONGEST = 200_000
UNDEFINED = "Measure without a definition, or one that refers to such"


def expand(defs: DataFrame, edges: DataFrame, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Whole texts of all nodes that lead to no cycle: model, measure_name, expr, why; and the edges of the others.

    A node is finished once all its references are: a finished node sends its text along the edges
    that name it, and a node whose edges have all got theirs is put together. One round per
    dependency level, each of which writes the open edges and the new texts once.

    A text can double from level to level. The length is worked out before a text is made; a node
    whose text would have more than `longest` characters is finished without one, and so is every
    node that refers to it: `expr` is null and `why` says so.
    """
    fresh = S.settle(
        defs.join(S.keyed(edges), NODE, "left_anti").select(*NODE, "expr", F.when(F.col("expr").isNull(), UNDEFINED).alias("why"))
    )
    done = [fresh]
    pending = edges.withColumns({"known": F.lit(False), "text": F.lit(None).cast("string"), "why": F.lit(None).cast("string")})
    while True:
        sent = fresh.select(
            "model", F.col("measure_name").alias("ref"), F.concat(F.lit("("), "expr", F.lit(")")).alias("new"),
            F.col("why").alias("new_why"), F.lit(True).alias("sent"),
        )
        met = S.salted_join(pending, sent, ["model", "ref"], "left", large=S.many(fresh))
        got = F.col("sent").isNotNull() & ~F.col("known")
        marked, (some,) = S.settle_counting(
            met.select(
                *NODE, "ref", (F.col("known") | F.col("sent").isNotNull()).alias("known"),
                F.coalesce("text", "new").alias("text"), F.coalesce("why", "new_why").alias("why"), got.alias("got"),
            ),
            F.col("got"),
        )
        if not some:
            return _union(done), marked.select(*NODE, "ref")
        whole = marked.groupBy(*NODE).agg(
            F.every("known").alias("all"), F.max("why").alias("why"), F.array_sort(F.collect_list(F.struct("ref", "text"))).alias("refs")
        )
        ready = S.keyed(defs).join(whole.where("all"), NODE)
        size = _put_length(F.col("expr"), F.col("refs"), F.col("mode"))
        too_long = F.lit(f"Expanded text exceeds {longest} characters")
        ready = ready.withColumn("why", F.coalesce("why", F.when(size > longest, too_long)))
        text = F.when(F.col("why").isNull(), _put(F.col("expr"), F.col("refs"), F.col("mode")))
        fresh = S.settle(ready.select(*NODE, text.alias("expr"), "why"))
        done.append(fresh)
        pending, (left,) = S.settle_counting(marked.drop("got").join(S.keyed(fresh), NODE, "left_anti"), F.lit(True))
        if not left:
            return _union(done), pending.select(*NODE, "ref")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def resolve_composites(staging: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Staging rows with `resolved_expr` where references were inlined.

    A row is expanded once, from definitions that are complete. Cyclic measures, measures that
    depend on them and measures whose text would have more than `longest` characters get status
    `error`.
    """
    defs = S.settle(definitions(staging))
    resolved, residual = expand(defs, _edges(defs), longest)
    cyclic = S.keyed(cycles(residual, peeled=True)).withColumn("__cyclic", F.lit(True))
    done = S.keyed(resolved).select(*NODE, F.col("expr").alias("__expr"), F.col("why").alias("__why"))
    df = staging.drop("resolved_expr").join(done, NODE, "left").join(cyclic, NODE, "left")
    own = F.concat(F.lit("Circular measure reference: "), F.col("measure_name"))
    message = F.when(F.col("__cyclic"), own).when(F.col("__why").isNotNull(), F.col("__why")).when(
        F.col("__expr").isNull(), F.lit("Depends on a circular measure reference")
    )
    df = df.withColumn("resolved_expr", F.when(F.col("__expr") != without_comments(F.col("measure_expr")), F.col("__expr")))
    df = df.withColumn("error_message", F.coalesce(message, F.col("error_message")))
    df = df.withColumn("final_status", F.when(message.isNotNull(), "error").otherwise(F.col("final_status")))
    return df.select(*staging.columns)
