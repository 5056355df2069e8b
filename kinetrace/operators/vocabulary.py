"""The task vocabulary: entries, mappings of task strings, an event log with undo, resolution and candidates.

The state is a fold of an append-only log. An event has a number, and two tables of effects: `moves`, what it set a task
string to and what that was before, and `changes`, the same of entries. The latest effect of a string or an entry is its
state; undoing an event appends its effects the other way round, once it is certain that nothing has changed them since.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions import tasks
from kinetrace.session import cut

MOVES = "seq long, task_string string, entry_id string, provenance string, was_entry string, was_provenance string"
CHANGES = "seq long, id string, label string, core string, alive boolean, was_label string, was_core string, was_alive boolean"
EVENTS = "seq long, kind string, undoes long"


def entry_id(label: str) -> str:
    """The identifier of an entry, from the label that it had first."""
    return "voc_" + hashlib.blake2b(label.strip().encode(), digest_size=8).hexdigest()


def mappings(moves: DataFrame) -> DataFrame:
    """(task_string, entry_id, provenance) of the strings that are mapped or dismissed."""
    last = moves.groupBy("task_string").agg(F.max_by(F.struct("entry_id", "provenance"), "seq").alias("x"))
    return last.select("task_string", "x.*").where("provenance is not null")


def entries(changes: DataFrame) -> DataFrame:
    """(id, label, core) of the entries that are there."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("label", "core", "alive"), "seq").alias("x"))
    return last.where("x.alive").select("id", "x.label", "x.core")


class Conflict(ValueError):
    """A label is taken, or what an operation relies on has changed."""


@dataclass(frozen=True)
class Vocabulary:
    """A log with its effects. Every operation returns the vocabulary after it; `cut` keeps the plans short."""

    spark: SparkSession
    events: DataFrame
    moves: DataFrame
    changes: DataFrame
    last: int = 0
    _labels: dict = field(default_factory=dict, compare=False)

    @classmethod
    def empty(cls, spark: SparkSession) -> Vocabulary:
        return cls(spark, *(spark.createDataFrame([], s) for s in (EVENTS, MOVES, CHANGES)))

    @property
    def mappings(self) -> DataFrame:
        return mappings(self.moves)

    @property
    def entries(self) -> DataFrame:
        return entries(self.changes)

    def _entry(self, where) -> list:
        return self.entries.where(where).limit(2).collect()

    def _known(self, id_: str):
        found = self._entry(F.col("id") == id_)
        if not found:
            raise KeyError(id_)
        return found[0]

    def _then(self, kind: str, moves: DataFrame | None = None, changes: list[tuple] | DataFrame = (), undoes: int | None = None) -> Vocabulary:
        seq = self.last + 1
        event = self.spark.createDataFrame([(seq, kind, undoes)], EVENTS)
        out = replace(self, events=cut(self.events.unionByName(event)), last=seq)
        if moves is not None:
            set_ = moves.select(F.lit(seq).cast("long").alias("seq"), "task_string", "entry_id", "provenance", "was_entry", "was_provenance")
            out = replace(out, moves=cut(self.moves.unionByName(set_)))
        if not isinstance(changes, DataFrame) and changes:
            changes = self.spark.createDataFrame([(seq, *c) for c in changes], CHANGES)
        if isinstance(changes, DataFrame):
            out = replace(out, changes=cut(self.changes.unionByName(changes.withColumn("seq", F.lit(seq).cast("long")))))
        return out

    def _moved(self, strings: DataFrame, entry: str | None, provenance: str | None) -> DataFrame:
        """Moves of task strings, with their state so far."""
        now = self.mappings.select("task_string", F.col("entry_id").alias("was_entry"), F.col("provenance").alias("was_provenance"))
        return strings.select("task_string").distinct().join(now, "task_string", "left").withColumns({"entry_id": F.lit(entry).cast("string"), "provenance": F.lit(provenance).cast("string")})

    def _strings(self, names) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "task_string string")

    def _free(self, label: str) -> str:
        label = label.strip()
        if not label:
            raise ValueError("an entry needs a label")
        if self._entry((F.col("label") == label) | (F.col("id") == entry_id(label))):
            raise Conflict(f"taken: {label}")
        return label

    def create(self, label: str, core: str | None = None) -> Vocabulary:
        """A new entry; one of that label is left as it is."""
        if self._entry(F.col("label") == label.strip()):
            return self
        label = self._free(label)
        return self._then("create", changes=[(entry_id(label), label, tasks.core_of(label) if core is None else core, True, None, None, False)])

    def map(self, task_string: str, entry: str, provenance: str = "confirm") -> Vocabulary:
        if provenance == "dismiss":
            raise ValueError("a dismissed string has no entry")
        self._known(entry)
        return self._then("map", self._moved(self._strings([task_string]), entry, provenance))

    def dismiss(self, task_string: str) -> Vocabulary:
        return self._then("dismiss", self._moved(self._strings([task_string]), None, "dismiss"))

    def rename(self, entry: str, label: str) -> Vocabulary:
        known, label = self._known(entry), label.strip()
        if not label:
            raise ValueError("an entry needs a label")
        if self._entry((F.col("label") == label) & (F.col("id") != entry)):
            raise Conflict(f"taken: {label}")
        return self._then("label", changes=[(entry, label, known.core, True, known.label, known.core, True)])

    def merge(self, source: str, target: str) -> Vocabulary:
        """All strings of the source go to the target, and the source goes."""
        if source == target:
            raise ValueError("an entry cannot merge into itself")
        known = self._known(source)
        self._known(target)
        moved = self._moved(self.mappings.where(F.col("entry_id") == source), target, "merge")
        return self._then("merge", moved, [(source, known.label, known.core, False, known.label, known.core, True)])

    def split(self, entry: str, task_strings: list[str], label: str) -> Vocabulary:
        """Some strings of an entry go to a new one."""
        if not task_strings:
            raise ValueError("a split names a string")
        self._known(entry)
        label, strings = self._free(label), self._strings(task_strings)
        missing = strings.join(self.mappings.where(F.col("entry_id") == entry), "task_string", "left_anti").limit(5).collect()
        if missing:
            raise Conflict(f"not mapped to {entry}: {', '.join(r.task_string for r in missing)}")
        return self._then("split", self._moved(strings, entry_id(label), "split"), [(entry_id(label), label, tasks.core_of(label), True, None, None, False)])

    def accept(self, task_strings: list[str], expected_core: str, seen: DataFrame, entry: str | None = None, label: str | None = None) -> Vocabulary:
        """A reviewed candidate, in one event: unmapped strings of one core go to its one entry, or to a new one.

        seen: the task strings (task_string) that the catalog has.
        """
        if not 1 <= len(set(task_strings)) <= 500 or (entry is None) == (not (label or "").strip()):
            raise ValueError("1 to 500 strings, and either an entry or a label")
        strings, of_core = self._strings(task_strings), self._entry(F.col("core") == expected_core)
        if entry is not None and (self._known(entry), [r.id for r in of_core])[1] != [entry] or entry is None and of_core:
            raise Conflict("the core's entries have changed")
        if any(tasks.core_of(t) != expected_core for t in task_strings):
            raise Conflict("a string has another core")
        if not strings.join(seen, "task_string", "left_anti").isEmpty() or not strings.join(self.mappings, "task_string", "left_semi").isEmpty():
            raise Conflict("a string is gone or no longer unmapped")
        if entry is not None:
            return self._then("map", self._moved(strings, entry, "confirm"))
        label = self._free(label)
        return self._then("map", self._moved(strings, entry_id(label), "confirm"), [(entry_id(label), label, tasks.core_of(label), True, None, None, False)])

    def undo(self, seq: int) -> Vocabulary:
        """Takes back one event, if all that it set is still as it set it; a new entry goes only if nothing maps to it."""
        event = self.events.where(F.col("seq") == seq).collect()
        if not event or event[0].kind == "undo":
            raise KeyError(seq)
        if not self.events.where(F.col("undoes") == seq).isEmpty():
            raise Conflict("already undone")
        moves, changes = (x.where(F.col("seq") == seq) for x in (self.moves, self.changes))
        now = self.mappings.select("task_string", F.struct("entry_id", "provenance").alias("now"))
        other = moves.join(now, "task_string", "left").where(~F.struct("entry_id", "provenance").eqNullSafe(F.coalesce("now", F.struct(F.lit(None).cast("string").alias("entry_id"), F.lit(None).cast("string").alias("provenance")))))
        states = self.changes.groupBy("id").agg(F.max_by(F.struct("label", "alive"), "seq").alias("now"))
        moved_on = changes.join(states, "id").where(~F.struct("label", "alive").eqNullSafe(F.col("now")))
        gone = moves.select(F.col("was_entry").alias("id")).where("id is not null").unionByName(moves.select(F.col("entry_id").alias("id")).where("id is not null")).distinct()
        gone = gone.join(self.entries, "id", "left_anti").join(changes.select("id"), "id", "left_anti")
        if not other.isEmpty() or not moved_on.isEmpty() or not gone.isEmpty():
            raise Conflict("what the event set has changed since")
        back = moves.select("task_string", F.col("was_entry").alias("entry_id"), F.col("was_provenance").alias("provenance"), F.col("entry_id").alias("was_entry"), F.col("provenance").alias("was_provenance"))
        reverse = changes.select("seq", "id", F.coalesce("was_label", "label").alias("label"), F.coalesce("was_core", "core").alias("core"), F.col("was_alive").alias("alive"), F.col("label").alias("was_label"), F.col("core").alias("was_core"), F.col("alive").alias("was_alive"))
        used = self.mappings.join(moves, "task_string", "left_anti").select(F.col("entry_id").alias("id")).distinct()
        reverse = reverse.join(used.withColumn("used", F.lit(True)), "id", "left").where("alive or used is null").drop("used")
        return self._then("undo", back, reverse.select("seq", "id", "label", "core", "alive", "was_label", "was_core", "was_alive"), undoes=seq)


def resolve(task_strings: DataFrame, mapping: DataFrame, entry: DataFrame) -> DataFrame:
    """(task_string, status, entry_id): dismissed, mapped, auto (one entry has the core) or unmapped; blank ones are dismissed.

    task_strings: task_string and core. One row a string, whatever its number of episodes.
    """
    only = entry.where("core <> ''").groupBy("core").agg(F.count("*").alias("n"), F.first("id").alias("auto_id")).where("n = 1").drop("n")
    t = task_strings.select("task_string", "core").distinct().join(mapping, "task_string", "left").join(only, "core", "left")
    status = F.when(F.trim("task_string") == "", "dismissed").when(F.col("provenance").isNotNull(), F.when(F.col("entry_id").isNull(), "dismissed").otherwise("mapped")).when(F.col("auto_id").isNotNull(), "auto").otherwise("unmapped")
    return t.select("task_string", status.alias("status"), F.coalesce("entry_id", F.when(status == "auto", F.col("auto_id"))).alias("entry_id"))


def unmapped(episodes: DataFrame, mapping: DataFrame, limit: int = 50, after: tuple[int, str] | None = None) -> DataFrame:
    """(task, episodes, first_seen) of the strings without a mapping, most episodes first; `after` is the last (episodes, task) seen."""
    n = episodes.where("coalesce(task, '') <> ''").groupBy("task").agg(F.count("*").alias("episodes"), F.min("created_at").alias("first_seen"))
    n = n.join(mapping.select(F.col("task_string").alias("task")), "task", "left_anti")
    if after is not None:
        n = n.where((F.col("episodes") < after[0]) | ((F.col("episodes") == after[0]) & (F.col("task") > after[1])))
    return n.orderBy(F.col("episodes").desc(), "task").limit(limit)


def health(episodes: DataFrame, mapping: DataFrame, entry: DataFrame) -> DataFrame:
    """One row: counts and shares of mapped, dismissed and unmapped strings and episodes, entries, and mappings without an entry."""
    per = episodes.select(F.coalesce("task", F.lit("")).alias("task_string")).groupBy("task_string").agg(F.count("*").alias("n"))
    j = per.join(mapping, "task_string", "left")
    named = F.col("task_string") != ""
    states = {"mapped": F.col("entry_id").isNotNull(), "dismissed": F.coalesce(F.col("provenance") == "dismiss", F.lit(False)), "unmapped": F.col("provenance").isNull()}
    c = j.agg(
        F.count_if(named).alias("task_strings"), F.coalesce(F.sum("n"), F.lit(0)).alias("episodes"),
        *[F.count_if(named & s).alias(f"{k}_strings") for k, s in states.items()],
        *[F.coalesce(F.sum(F.when(named & s, F.col("n"))), F.lit(0)).alias(f"{k}_episodes") for k, s in states.items()],
    )
    lost = mapping.where("entry_id is not null").join(entry.select(F.col("id").alias("entry_id")), "entry_id", "left_anti").agg(F.count("*").alias("orphaned_mappings"))
    there = entry.agg(F.count("*").alias("entries"))
    one = c.withColumn("_", F.lit(1)).join(lost.withColumn("_", F.lit(1)), "_").join(there.withColumn("_", F.lit(1)), "_").drop("_")
    for k in ("string", "episode"):
        one = one.withColumn(f"unmapped_{k}_share", F.coalesce(F.try_divide(f"unmapped_{k}s", "task_strings" if k == "string" else "episodes"), F.lit(0.0)))
    return one


def listing(episodes: DataFrame, mapping: DataFrame, entry: DataFrame) -> DataFrame:
    """(id, label, core, task_count, episodes) of the entries."""
    n = episodes.groupBy(F.col("task").alias("task_string")).agg(F.count("*").alias("n"))
    used = mapping.where("entry_id is not null").join(n, "task_string", "left").groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("task_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("episodes"))
    return entry.join(used, "id", "left").select("id", "label", "core", F.coalesce("task_count", F.lit(0)).alias("task_count"), F.coalesce("episodes", F.lit(0)).alias("episodes"))


def candidates(unmapped_: DataFrame, entry: DataFrame) -> DataFrame:
    """(core, kind, task_strings, n_strings, episodes, entry_id, label): unmapped strings by core, to attach to its one entry or to make one.

    unmapped_: task_string, core, episodes. Cores with several entries give none.
    """
    found = unmapped_.where("core <> ''").groupBy("core").agg(F.array_sort(F.collect_set("task_string")).alias("task_strings"), F.sum("episodes").alias("episodes"))
    of = entry.where("core <> ''").groupBy("core").agg(F.count("*").alias("k"), F.min(F.struct("id", "label")).alias("e"))
    j = found.join(of, "core", "left").where("k is null or k = 1")
    return j.select("core", F.when(F.col("k") == 1, "attach").otherwise("new_entry").alias("kind"), "task_strings", F.size("task_strings").alias("n_strings"), "episodes", F.col("e.id").alias("entry_id"), F.col("e.label").alias("label"))


def majority_match(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(label, key, overlap): for each confirmed set (label, task) the group (key, task) with more than half of its tasks.

    The largest overlap wins, then the largest key; of labels that meet in one group the largest stays.
    """
    size = wanted.distinct().groupBy("label").agg(F.count("*").alias("n"))
    both = wanted.distinct().join(members.select("key", "task").distinct(), "task").groupBy("label", "key").agg(F.count("*").alias("overlap")).join(size, "label").where("overlap * 2 > n")
    best = both.groupBy("label").agg(F.max(F.struct("overlap", "key")).alias("x")).select("label", "x.key", "x.overlap")
    return best.groupBy("key").agg(F.max(F.struct("label", "overlap")).alias("x")).select("x.label", "key", "x.overlap")
