"""Call graph operators. Every key holds the task: scans see their own files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Classes outside the code under review, by the beginning of their names (fixed values).
EXTERNAL = r"^(java\.|javax\.|sun\.|com\.sun\.|org\.springframework\.|org\.junit\.|<)"


def unused_methods(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods that can't be entered from outside and whose name nobody calls.

    A call by name subsumes calls by class or signature, so one anti-join decides.
    """
    entry = F.col("is_public") | F.col("is_override") | F.col("is_ctor") | F.col("is_abstract") | F.col("is_native")
    own = methods.filter(~F.coalesce(entry, F.lit(False))).filter(~F.col("class_name").rlike(EXTERNAL))
    called = edges.select("task_id", F.col("callee").alias("method")).distinct()
    return own.join(called, ["task_id", "method"], "left_anti")


def deduplicated(methods: DataFrame, order: str) -> DataFrame:
    """One row of each method of a task by class, name and descriptor: the last in the order."""
    key = ["task_id", "class_name", "method", "descriptor"]
    rest = [c for c in methods.columns if c not in key]
    return methods.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*key, "_last.*").select(*methods.columns)


def callers_of(edges: DataFrame) -> DataFrame:
    """Each callee with its number of callers and calls and its first caller."""
    return edges.groupBy("task_id", "callee_class", "callee").agg(F.count_distinct("caller").alias("callers"), F.count(F.lit(1)).alias("calls"), F.min("caller").alias("first_caller"))


def graph_stats(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each task with methods: its methods, classes, calls and names called."""
    m = methods.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_methods"), F.count_distinct("class_name").alias("n_classes"))
    e = edges.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("callee").alias("n_called"))
    return m.join(e, "task_id", "left").fillna(0, ["n_edges", "n_called"])


def deprecated_calls(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls to a deprecated method of the same file, by name: one row for each matching method."""
    old = methods.filter("is_deprecated").select("task_id", "file_path", F.col("method").alias("callee"), "arity")
    return edges.join(old, ["task_id", "file_path", "callee"])


def nonnull_returns(seeds: DataFrame, depends: DataFrame, rounds: int | None = 5) -> DataFrame:
    """Methods (task_id, method) proven never to return null: the seeds, and those all of whose returned calls are proven, grown for some
    rounds, or until nothing grows.

    depends: task_id, method, on (a method whose result it returns), and unit where several bodies share a method's name: one of which is
    enough. seeds: task_id, method. A round meets only what the last one proved, and counts down what each unit still waits for.
    """
    key = ["task_id", "unit"]
    unit = F.col("unit") if "unit" in depends.columns else F.col("method")
    links = checkpointed(depends.select("task_id", unit.alias("unit"), "method", "on").distinct())
    waits = links.groupBy(*key, "method").agg(F.count(F.lit(1)).alias("waits"))
    known = new = checkpointed(seeds.select("task_id", "method").distinct())
    done = 0
    while (rounds is None or done < rounds) and new.limit(1).count():
        met = links.join(new.select("task_id", F.col("method").alias("on")), ["task_id", "on"]).groupBy(*key).agg(F.count(F.lit(1)).alias("met"))
        waits = checkpointed(waits.join(met, key, "left").select(*key, "method", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")))
        new = checkpointed(waits.filter("waits = 0").select("task_id", "method").distinct().join(known, ["task_id", "method"], "left_anti"))
        waits = waits.filter("waits > 0")
        known = known.union(new)
        done += 1
    return known


def with_guards(points: DataFrame, guards: DataFrame) -> DataFrame:
    """points (task_id, file_path, method_at, name, pos, ...) with guarded: whether a guard (..., s, e: from s up to before e) of their name covers them.

    A sweep: by place in the text, a point is covered if the furthest end of the guards that began before reaches beyond it.
    """
    key = ["task_id", "file_path", "method_at", "name"]
    rest = [c for c in points.columns if c not in key]
    row = F.struct(*rest)
    kind = points.select(row.alias("r")).schema["r"].dataType
    ends = guards.select(*key, F.col("s").alias("_at"), F.col("e").alias("_end"), F.lit(0).alias("_point"), F.lit(None).cast(kind).alias("_row"))
    own = points.select(*key, F.col("pos").alias("_at"), F.lit(None).cast("int").alias("_end"), F.lit(1).alias("_point"), row.alias("_row"))
    before = Window.partitionBy(*key).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends.unionByName(own).withColumn("_reach", F.max("_end").over(before)).filter("_point = 1")
    return swept.select(*key, "_row.*", F.coalesce(F.col("_reach") > F.col("_at"), F.lit(False)).alias("guarded")).select(*points.columns, "guarded")


def unguarded(points: DataFrame, guards: DataFrame) -> DataFrame:
    return with_guards(points, guards).filter("NOT guarded").drop("guarded")


def _held_by_guards(needs: DataFrame, guards: DataFrame) -> DataFrame:
    """Needs of names that a guard covers hold: arg_kind self."""
    asks = F.col("pos").isNotNull() & (F.col("arg_kind") != "self")
    named = with_guards(needs.filter(asks), guards)
    return needs.filter(~asks).unionByName(named.withColumn("arg_kind", F.when(F.col("guarded"), "self").otherwise(F.col("arg_kind"))).drop("guarded"))


def returns_of(read_files: DataFrame) -> DataFrame:
    """Methods (task_id, method: name/arity) of trees that never return null, by what each body returns, through its locals and the methods whose results
    it hands on. A parameter counts where it is guarded or vouched for."""
    from .java_rules import relation

    guards = relation(read_files, "guard").filter("form != 'checked'")
    sites = relation(read_files, "null_site").filter(F.col("param").startswith("="))
    local = F.concat_ws("|", "scope_type", "param")
    units = relation(read_files, "null_return").withColumn("unit", F.concat_ws("@", "file_path", "unit")).drop("scope_type")
    units = units.unionByName(sites.withColumn("unit", local).withColumn("method", local).drop("param", "scope_type", "caller_types"))
    units = _held_by_guards(units, guards)
    on = F.when(F.col("arg_kind") == "ret", F.col("arg")).when((F.col("arg_kind") == "param") & F.col("arg").startswith("="), F.concat_ws("|", "arg_class", "arg"))
    needs = checkpointed(units.select("task_id", "unit", "method", on.alias("on"), F.col("arg_kind") == "self").toDF("task_id", "unit", "method", "on", "holds"))
    whole = needs.groupBy("task_id", "unit", "method").agg(F.bool_and(F.col("holds") | F.col("on").isNotNull()).alias("can"), F.bool_and("holds").alias("sure")).filter("can")
    waiting = needs.filter("on IS NOT NULL AND NOT holds").join(whole.filter("NOT sure").select("task_id", "unit"), ["task_id", "unit"], "left_semi")
    known = nonnull_returns(whole.filter("sure"), waiting.select("task_id", "unit", "method", "on"), rounds=None)
    return known.filter(~F.col("method").contains("|="))


def resolved_sites(read_files: DataFrame) -> DataFrame:
    """What calls pass, where guards and methods that never return null are taken into account: arg_kind self, param or none."""
    from .java_rules import relation

    sites = _held_by_guards(relation(read_files, "null_site"), relation(read_files, "guard").filter("form != 'checked'"))
    proven = returns_of(read_files).select("task_id", F.col("method").alias("arg"), F.lit(True).alias("_given"))
    rest = sites.filter("arg_kind != 'ret'")
    given = sites.filter("arg_kind = 'ret'").join(proven, ["task_id", "arg"], "left")
    given = given.withColumn("arg_kind", F.when(F.col("_given"), "self").otherwise("none")).drop("_given")
    return rest.unionByName(given)


def null_proof(candidates: DataFrame, sites: DataFrame, depth: int = 6) -> DataFrame:
    """Candidate parameters (task_id, param) with whether they are proven non-null: proven if they have call sites and every site's argument
    is.

    candidates: task_id, param. sites: task_id, param, arg_kind (self: evident, param: hangs on another parameter, none: not provable), arg
    (that parameter). Parameters start as proven (cycles are taken in good faith) and fall round by round, as far as the depth
    allows; what would need a deeper chain falls too. What is evident of a parameter's sites is written once, beside the
    parameters that the rest hang on.
    """
    key = ["task_id", "param"]
    kind = F.col("arg_kind")
    evident = sites.groupBy(*key).agg(F.bool_and(kind.isin("self", "param")).alias("ok"))
    hangs = checkpointed(sites.filter(kind == "param").select(*key, "arg").distinct())
    state = candidates.select(*key).distinct().join(evident, key, "left").select(*key, F.coalesce("ok", F.lit(False)).alias("proven"))
    state = checkpointed(state)
    for _ in range(depth):
        of = state.select("task_id", F.col("param").alias("arg"), F.col("proven").alias("arg_proven"))
        met = hangs.join(of, ["task_id", "arg"], "left").groupBy(*key).agg(F.bool_and(F.coalesce("arg_proven", F.lit(False))).alias("ok"))
        after = state.join(met, key, "left").select(*key, (F.col("proven") & F.coalesce("ok", F.lit(True))).alias("proven"), F.col("proven").alias("was"))
        after = checkpointed(after)
        state = after.select(*key, "proven")
        if not after.filter("proven != was").limit(1).count():
            break
    return state


def attributed_proof(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """candidates (task_id, param, class_name, is_private, ...) with proven: whether they have call sites of their own, and everything that those pass is
    proven.

    A site is a parameter's own if it is made on the parameter's class, or on a type that the file doesn't tell; a private method's
    then only from within its class. So each site tells what it passes under a few keys (its scope's type, or any scope and each type around it), a
    parameter listens to one or two of them, and both are folded to the key before they meet: no candidate meets a site. Parameters that
    hang on each other in a circle are taken in good faith; what hangs on one that falls, falls in the next round, which meets only those
    that fell in the last.

    sites: task_id, param, arg_kind (self, param, none), arg, arg_class, arg_private (the parameter that it hangs on), scope_type, caller_types.
    """
    node = lambda cls, private, param: F.concat_ws("\u0001", F.coalesce(cls, F.lit("")), F.coalesce(private, F.lit(False)).cast("string"), param)
    named = F.concat(F.lit("T:"), "scope_type")
    keys = F.when(F.col("scope_type").isNotNull(), F.array(named)).otherwise(F.concat(F.array(F.lit("A")), F.transform("caller_types", lambda t: F.concat(F.lit("E:"), t))))
    told = sites.select("task_id", "param", "arg_kind", node(F.col("arg_class"), F.col("arg_private"), F.col("arg")).alias("on"), F.explode(F.array_distinct(keys)).alias("key"))
    told = checkpointed(told.distinct())
    own = candidates.select("task_id", F.col("class_name").alias("cls"), F.col("is_private").alias("private"), "param")
    asked = sites.filter("arg_kind = 'param'").select("task_id", F.col("arg_class").alias("cls"), F.col("arg_private").alias("private"), F.col("arg").alias("param"))
    nodes = own.union(asked).distinct().withColumn("node", node(F.col("cls"), F.col("private"), F.col("param")))
    listens = F.when(F.col("param").startswith("="), F.array(F.concat(F.lit("T:"), "cls"))).otherwise(F.array(F.concat(F.lit("T:"), "cls"), F.when(F.col("private"), F.concat(F.lit("E:"), "cls")).otherwise("A")))
    listens = checkpointed(nodes.select("task_id", "node", "param", F.explode(listens).alias("key")))
    place = ["task_id", "param", "key"]
    folded = told.groupBy(*place).agg(F.bool_and(F.col("arg_kind") != "none").alias("ok"))
    sound = listens.join(folded, place, "left").groupBy("task_id", "node").agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"))
    fallen = new = checkpointed(sound.filter(~F.col("ok")).select("task_id", "node"))
    links = checkpointed(told.filter("arg_kind = 'param'").select(*place, "on"))
    while new.limit(1).count():
        keys = links.join(new.withColumnRenamed("node", "on"), ["task_id", "on"]).select(*place).distinct()
        new = checkpointed(listens.join(keys, place).select("task_id", "node").distinct().join(fallen, ["task_id", "node"], "left_anti"))
        fallen = fallen.union(new)
    out = candidates.withColumn("_node", node(F.col("class_name"), F.col("is_private"), F.col("param")))
    fell = fallen.select("task_id", F.col("node").alias("_node"), F.lit(False).alias("_kept"))
    return out.join(fell, ["task_id", "_node"], "left").withColumn("proven", F.coalesce("_kept", F.lit(True))).drop("_node", "_kept")


def ambiguous_names(types: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """Each name's type if it has one only, else null."""
    return types.groupBy(name).agg(F.when(F.count_distinct(kind) == 1, F.min(kind)).alias(kind))
