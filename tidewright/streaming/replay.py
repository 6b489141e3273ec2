"""Lists changed by many at once: toggles, additions and removals replayed in order, none lost.

A client that writes back its own copy of a list loses what others wrote meanwhile. Here each change is a row
of a changelog (list, member, version, op): ``toggle``, ``add`` or ``remove`` one member. Changes of different
members commute, so order only matters within a (list, member), whose changes are numbered from 1 without gaps.
State is kept in buckets by a hash of both: a list with a third of all changes is spread by its members, and Python
is called once for a bucket and batch, not for each member.

As a stream, a change that comes before its predecessors waits in the state until they have come; one that comes
again is known by its version and does nothing. As a table, the last addition or removal and the number of
toggles after it decide, which sums up within tasks before anything is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ("list", "member")
#: Buckets of the state. A stream keeps the number that it began with.
BUCKETS = 4096
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(present: bool, op: str) -> bool:
    """Membership after a change; an unknown one changes nothing."""
    return {"toggle": not present, "add": True, "remove": False}.get(op, present)


class _Bucket(StatefulProcessor):
    """The members of a bucket: of each whether it is in, the last version applied, and changes that wait for earlier ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "members string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        members, touched = json.loads((self.state.get() or ("{}",))[0]), {}
        for part in rows:
            for of, v, op in zip(part["of"], part["version"], part["op"], strict=True):
                member = members.setdefault(of, [0, False, {}])
                if pd.notna(v) and v > member[0]:
                    member[2][str(int(v))] = op
                    touched[of] = member[0]
        for of in touched:
            version, present, waiting = members[of]
            while str(version + 1) in waiting:
                version += 1
                present = applied(present, waiting.pop(str(version)))
            members[of] = [version, present, waiting]
        self.state.update((json.dumps(members),))
        on = [of for of, before in touched.items() if members[of][0] > before]
        if on:
            yield pd.DataFrame({"of": on, "version": [members[of][0] for of in on], "present": [members[of][1] for of in on]})

    def close(self) -> None:
        pass


def replay_stream(changes: DataFrame) -> DataFrame:
    """(list, member, version, present) after each batch that brought a (list, member) forward; update mode.

    ``transformWithState`` keeps its state in RocksDB, for which the session is set. A call takes all changes of a bucket.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kinds = ", ".join(f"{k} {changes.schema[k].dataType.simpleString()}" for k in KEY)
    rows = changes.select(F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).alias("bucket"), F.to_json(F.struct(*KEY), _TIMES).alias("of"), F.col("version").cast("long").alias("version"), "op")
    out = rows.groupBy("bucket").transformWithStateInPandas(_Bucket(), "of string, version long, present boolean", "update", "none")
    return out.withColumn("of", F.from_json("of", kinds, _TIMES)).select(*[F.col("of")[k].alias(k) for k in KEY], "version", "present")


def replayed(changes: DataFrame) -> DataFrame:
    """(list, member, version, present) after all changes of a table; a change that is there twice counts once.

    An empty table gives no rows. Changes without version are left out.
    """
    once = changes.where("version is not null").groupBy(*KEY, "version").agg(F.min("op").alias("op"))
    fixed = F.when(F.col("op").isin("add", "remove"), F.col("version"))
    state = once.withColumn("fixed", fixed).groupBy(*KEY).agg(F.max("version").alias("version"), F.max("fixed").alias("at"), F.max_by("op", "fixed").alias("last"))
    toggles = once.where("op = 'toggle'").alias("c").join(state.select(*KEY, "at").alias("s"), [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEY])
    after = toggles.where("s.at is null or c.version > s.at").groupBy(*[F.col(f"c.{k}").alias(k) for k in KEY]).agg(F.count("*").alias("n"))
    joined = state.alias("s").join(after.alias("a"), [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in KEY], "left")
    odd = F.coalesce(F.col("a.n") % 2 == 1, F.lit(False))
    return joined.select(*[F.col(f"s.{k}") for k in KEY], "s.version", (F.coalesce(F.col("s.last") == "add", F.lit(False)) != odd).alias("present"))


def lists(states: DataFrame) -> DataFrame:
    """(list, members): the members of each list in order; a list without any has no row."""
    now = states.groupBy(*KEY).agg(F.max_by("present", "version").alias("present")).where("present")
    return now.groupBy("list").agg(F.array_sort(F.collect_list("member")).alias("members"))
