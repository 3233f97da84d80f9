"""A session reads scripts, plans their relations and acts on them: in batch, or as streaming queries."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from rivulet import explain as explain_
from rivulet.config import Config
from rivulet.errors import FlowError
from rivulet.functions.builtins import Aggregate
from rivulet.functions.managed import Function, Timer, managed
from rivulet.plans.ast import Step
from rivulet.plans.parser import parse
from rivulet.plans.planner import Planner, Relation
from rivulet.sources import custom, sinks
from rivulet.storage import settings, shared_dir
from rivulet.streaming.keyed import Stateful
from rivulet.types import name_of


class Session:
    """register_* make Python names known to scripts; run() executes one; relation() gives a DataFrame."""

    def __init__(self, spark: SparkSession, stream: bool = False, config: Config | dict | None = None, out: Callable[[str], None] = print, fuse: bool = True):
        self.spark, self.out = spark, out
        self.config = config if isinstance(config, Config) else Config(config or {})
        self.planner = Planner(spark, stream, fuse=fuse)
        self.dumpers = dict(sinks.DUMPERS)
        self.steps: list[Step] = []
        self.actions: list[Step] = []
        self.queries: list = []

    # ---- what scripts may name

    def register_function(self, name: str, f: Callable) -> None:
        """A function of columns that returns a column: an expression, udf() or pandas_udf()."""
        self.planner.functions[name] = f

    def register_aggregate(self, name: str, grouped: Callable, bag: Callable | None = None) -> None:
        """An aggregate, for groups and windows: grouped makes an aggregate expression of a column of values.

        Built of Spark's own aggregates it is combined before the shuffle; a pandas_udf of a series to a number does as well,
        without that. bag makes an expression of an array of the values, for bags that are built before; where it is
        missing those are an error.
        """

        def unknown(values, _):
            raise FlowError(f"{name} needs a group, not a bag that was built before", 1053)

        self.planner.functions[name] = Aggregate(lambda c, t: grouped(c), unknown if bag is None else lambda c, t: bag(c))

    def register_managed(self, name: str, make: Callable[[], Function], returns: str, within: float | None = None, default: object = None) -> Timer:
        """A Python function with prepare, call and cleanup, given what the config has for its name; calls longer than within seconds give default."""
        timer = Timer(self.spark)
        self.planner.functions[name] = managed(make, returns, self.config.of(function=name), within, default, timer)
        return timer

    def register_stream(self, name: str, f: Callable, keys: list[str] | None = None, state: object = None, timeout: str = "NoTimeout") -> None:
        """A generator over pandas frames, for STREAM ... THROUGH; options after # come as keywords.

        With keys it is f(key, frames, state, **options) for each key, and state, Spark's group state of the schema given,
        stays from one batch of a stream to the next.
        """
        self.planner.streams[name] = f if keys is None else Stateful(f, keys, state, timeout)

    def register_comparator(self, name: str, key: Callable | None = None, compare: Callable[[tuple, tuple], int] | None = None) -> None:
        """For ORDER ... USING: a function of a column that returns the column to sort by, or a comparison of two tuples of the sort columns' values."""
        self.planner.comparators[name] = (key, compare)

    def register_tap(self, name: str, tap: Callable) -> None:
        """A function like those of rivulet.sources.taps, or a class of sources.custom.Tap."""
        self.planner.taps[name] = custom.source(tap) if isinstance(tap, type) and issubclass(tap, custom.Tap) else tap

    def register_dumper(self, name: str, dumper: Callable[..., sinks.Dumper]) -> None:
        self.dumpers[name] = dumper

    def register_frame(self, alias: str, df: DataFrame) -> None:
        self.planner.relations[alias] = Relation(df)

    # ---- scripts

    def load(self, script: str, parameters: dict | None = None) -> Session:
        """Plans a script's relations; its actions wait for run()."""
        with settings(self.spark):
            for step in parse(script, parameters):
                self.steps.append(step)
                self._plan(step)
        return self

    def _plan(self, step: Step) -> None:
        if step.verb in ("dump", "store", "describe", "explain"):
            self.planner.get(step.args["of"], step)
            self.actions.append(step)
        elif step.verb == "define":
            self._define(step)
        elif step.verb == "register":
            importlib.import_module(step.args["module"]).register(self)
        elif step.verb == "set":
            self.config.values[step.args["key"]] = step.args["value"].value
        else:
            self.planner.run(step)

    def _define(self, step: Step) -> None:
        """DEFINE f target(args): target with its last arguments given, or a tap with arguments."""
        from pyspark.sql import functions as F

        from rivulet.functions.builtins import SCALARS

        name, target, args = step.alias, step.args["target"], step.args["args"]
        p = self.planner
        p.aliases[name] = (target, args)
        if target in p.functions:
            f = p.functions[target]
            p.functions[name] = lambda *a: f(*a, *map(F.lit, args))
        elif target in p.streams:
            p.streams[name] = p.streams[target]
        elif target in SCALARS:
            from pyspark.sql import types as T

            f = SCALARS[target]
            p.functions[name] = lambda *a: f([*a, *map(F.lit, args)], [T.StringType()] * (len(a) + len(args)))

    def relation(self, alias: str) -> DataFrame:
        with settings(self.spark):
            return self.planner.df(alias)

    def run(self, script: str | None = None, parameters: dict | None = None) -> Session:
        """Loads a script, if one is given, and does what waits; on a stream each sink becomes a running query."""
        if script is not None:
            self.load(script, parameters)
        waiting, self.actions = self.actions, []
        with settings(self.spark):
            kept = [self.planner.df(x).persist(StorageLevel.DISK_ONLY) for x in self._shared(waiting)] if self.config.flag("share") else []
            try:
                for step in waiting:
                    self._act(step)
            finally:
                for df in kept:
                    df.unpersist()
        return self

    def _shared(self, waiting: list[Step]) -> list[str]:
        """With the setting share: relations behind a shuffle that several sinks are made of, the last such on each way to a sink."""
        made: dict[str, list[str]] = {}
        heavy: set[str] = set()
        for step in self.steps:
            names = [n for n, _ in step.args["branches"]] + [step.args["otherwise"]] if step.verb == "split" else [step.alias]
            for name in filter(None, names):
                made[name] = explain_.inputs(step)
                if step.verb in ("group", "cogroup", "join", "cross", "distinct", "order", "rank", "cube", "intersect", "except", "stream") or heavy & {*made[name]}:
                    heavy.add(name)

        def behind(alias: str, found: set[str]) -> set[str]:
            if alias not in found:
                found.add(alias)
                for x in made.get(alias, []):
                    behind(x, found)
            return found

        sinks_of = [behind(step.args["of"], set()) for step in waiting if step.verb in ("dump", "store")]
        shared = {x for x in heavy if sum(x in s for s in sinks_of) > 1 and not self.planner.get(x).lazy and not self.planner.df(x).isStreaming}
        used_by_shared = {y for x in shared for y in made.get(x, [])}
        return sorted(shared - used_by_shared)

    def _act(self, step: Step) -> None:
        alias, using = step.args["of"], step.args.get("using")
        using = self.planner.aliases.get(using[0], using) if using else None
        df = self.planner.df(alias)
        if step.verb == "describe":
            self.out(f"{alias}: {{" + ", ".join(f"{f.name}: {name_of(f.dataType)}" for f in df.schema) + "}")
        elif step.verb == "explain":
            self.out(explain_.text(df))
        elif df.isStreaming:
            self.queries.append(self._start(df, step, using))
        elif step.verb == "store":
            sinks.store(df, step.args["path"], using)
        else:
            sinks.dump(alias, df.toLocalIterator(), self._dumper(using))

    def _dumper(self, using: tuple[str, list] | None) -> sinks.Dumper:
        if using is None:
            return sinks.TextDumper(self.out)
        if using[0] not in self.dumpers:
            raise FlowError(f"no dumper named {using[0]}", 1005)
        return self.dumpers[using[0]](*using[1])

    def _start(self, df: DataFrame, step: Step, using: tuple[str, list] | None):
        """A streaming query into the sink. Its checkpoint is in the folder of the setting checkpoint, or in the shared folder.

        STORE of appended rows is Spark's own file sink, which has each batch once. Of a complete result the newest
        replaces the files; of updates each batch has a folder by its number, so that one that is written again replaces itself.
        Without the setting trigger a query ends when it has read what there is.
        """
        options = self.config.of(step.args["of"])
        mode, every = options.get("mode", "append"), options.get("trigger")
        where = f"{options['checkpoint']}/{step.args['of']}" if "checkpoint" in options else f"{shared_dir(self.spark)}/streams-{uuid.uuid4().hex}"
        if step.verb == "store" and mode == "append":
            writer = sinks.appending(df, step.args["path"], using)
        else:
            dumper = self._dumper(using) if step.verb == "dump" else None

            def batch(rows: DataFrame, number: int) -> None:
                if dumper is not None:
                    sinks.dump(step.args["of"], rows.toLocalIterator(), dumper)
                else:
                    sinks.store(rows, step.args["path"] if mode == "complete" else f"{step.args['path']}/batch={number}", using or (sinks.default(step.args["path"]), []))

            writer = df.writeStream.foreachBatch(batch)
        writer = writer.outputMode(mode).option("checkpointLocation", where)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def wait(self, seconds: float | None = None) -> None:
        for q in self.queries:
            q.awaitTermination(seconds) if seconds else q.awaitTermination()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    # ---- looking at it

    def dot(self) -> str:
        return explain_.dot(self.steps)


def start(spark: SparkSession, script: str, config: dict | None = None, **registered: Callable) -> Session:
    """An embedded service: a script's sinks as queries that run until stop() ends them, a batch each time that there is something new."""
    s = Session(spark, stream=True, config={"trigger": "0 seconds"} | (config or {}))
    for name, f in registered.items():
        s.register_function(name, f)
    return s.run(Path(script).read_text() if script.endswith(".flow") else script)
