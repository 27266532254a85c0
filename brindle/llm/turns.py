"""Conversation turns reassembled from a stream of late, repeated and missing arrivals.

A stateful Structured Streaming query with two stages, started anew for each batch on one checkpoint:

* Turns of a conversation are parted into blocks of BLOCK turns, so that a conversation of very many turns is spread over tasks. A
  block keeps its turns' roles and its fragments (maximal gapless runs of kept turns) in MapStates that index them by their
  start and by their end. An arrival looks up the fragment that ends before it and the one that starts after it and joins
  them, in constant time, with their counts of role breaks. The block reports a label for each arrival (new or a repeat) and
  one row of facts: its counts, the end of the fragment at its start, and the roles at its two edges.
* A conversation takes its blocks' facts (a row for each block that a batch touched, labels only pass by under their block's
  key), joins fragments over the edges of blocks, and releases the fragment at its next turn. A processing-time timer stands
  for each batch without an arrival: PATIENCE of them close the conversation, and so does the end.

No task sees more of a conversation than a block's turns or its blocks' facts. Payloads aren't state: labels and releases are
joined with the batches as they were fed, on (conversation, turn, batch). If a batch's run is lost, starting again on the
checkpoint runs it again with the state it had before.

Defined results: rows without a turn are dropped; a null role or text is empty; a null id is a conversation of its own; of a
turn's arrivals in a batch the smallest payload by its UTF-8 bytes counts; a turn that is kept stays as it is; what arrives
after closing is rejected; an empty batch counts as a batch; a role of a very long text or a very long text is carried
whole; other columns take no part. Blocks of closed conversations stay in the first stage's state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from brindle.llm import store

#: Turns of a block (a power of two); batches without an arrival that close a conversation.
BLOCK, PATIENCE = 1 << 8, 3
FED = "conv string, turn bigint, first bigint, batch int, payload string, role string, text string"
#: part: the block of a label's key, null for facts. run: the last turn of the fragment at the block's start (or at the first turn).
FACTS = "conv string, part bigint, turn bigint, new boolean, batch int, first bigint, block bigint, n bigint, largest bigint, breaks bigint, run bigint, low_role string, high_role string"
MADE = "kind string, conv string, turn bigint, new boolean, batch int, upto bigint, n_missing bigint, n_breaks bigint"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a start's stores are closed as its tasks end, so that executors hold few at a time, and take the disk that they fill
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # no reads before writes and no second file for each file, which cost more than the few rows of a store
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    # the same atomic rename by the file system's own API, without a child process for each file's permissions where files are local
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    # one micro-batch for each start: timers count batches
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


_facts, _made = (Row(*[part.split()[0] for part in schema.split(", ")]) for schema in (FACTS, MADE))


class _Held:
    """A MapState read once for each key and written once, with the changes."""

    def __init__(self, state):
        self.state, self.now, self.was = state, {}, {}

    def get(self, key: int) -> tuple | None:
        if key not in self.now:
            self.now[key] = self.was[key] = tuple(found) if (found := self.state.getValue((key,))) is not None else None
        return self.now[key]

    def put(self, key: int, value: tuple | None) -> None:
        self.get(key)
        self.now[key] = value

    def write(self) -> None:
        for key, value in self.now.items():
            if value != self.was[key]:
                self.state.removeKey((key,)) if value is None else self.state.updateValue((key,), value)


class Blocks(StatefulProcessor):
    """Fragments of a block of turns."""

    def init(self, handle) -> None:
        self.roles = handle.getMapState("roles", "turn bigint", "role string")
        self.starts = handle.getMapState("starts", "turn bigint", "upto bigint")
        self.ends = handle.getMapState("ends", "turn bigint", "from_ bigint")
        self.facts = handle.getValueState("facts", "n bigint, largest bigint, breaks bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv, block = key
        roles, starts, ends = _Held(self.roles), _Held(self.starts), _Held(self.ends)
        n, largest, breaks = found if (found := self.facts.get()) is not None else (0, None, 0)
        batch = first = None
        for row in rows:
            turn, batch, first = row.turn, row.batch, row.first
            new = roles.get(turn) is None
            yield _facts(conv, block, turn, new, batch, first, None, None, None, None, None, None, None)
            if not new:
                continue
            roles.put(turn, (row.role,))
            left, right = ends.get(turn - 1), starts.get(turn + 1)
            # roles stand only at the edges of fragments that the arrival touches
            breaks += (left is not None and roles.get(turn - 1)[0] == row.role) + (right is not None and roles.get(turn + 1)[0] == row.role)
            from_, upto = left[0] if left else turn, right[0] if right else turn
            if left:
                ends.put(turn - 1, None)
            if right:
                starts.put(turn + 1, None)
            starts.put(from_, (upto,))
            ends.put(upto, (from_,))
            n, largest = n + 1, turn if largest is None else max(turn, largest)
        low, high = block * BLOCK, (block + 1) * BLOCK - 1
        run, low_role, high_role = starts.get(max(low, first)), roles.get(low), roles.get(high)
        for held in (roles, starts, ends):
            held.write()
        self.facts.update((n, largest, breaks))
        yield _facts(conv, None, None, None, batch, first, block, n, largest, breaks, run and run[0], low_role and low_role[0], high_role and high_role[0])

    def close(self) -> None:
        pass


class Conversations(StatefulProcessor):
    """Releases and closings of a conversation, from its blocks' facts. end: the number of the batch that stands for the end."""

    def __init__(self, end: int, patience: int):
        self.end, self.patience = end, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("facts", "first bigint, next bigint, last int, silent int, timer bigint, closed boolean, n bigint, largest bigint, breaks bigint")
        self.blocks = handle.getMapState("blocks", "block bigint", "n bigint, breaks bigint, run bigint, low_role string, high_role string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv, part = key
        if part is not None:
            for row in rows:
                yield _made("turn", conv, row.turn, row.new, row.batch, None, None, None)
            return
        found = self.state.get()
        if found is not None and found[5]:
            return
        blocks, batch, timer = _Held(self.blocks), None, None
        first, next_, timer, n, largest, breaks = (found[0], found[1], found[4], found[6], found[7], found[8]) if found is not None else (None, None, None, 0, None, 0)
        for row in rows:
            batch = row.batch
            if first is None:
                first = next_ = row.first
            was = blocks.get(row.block) or (0, 0, None, None, None)
            n, breaks = n + row.n - was[0], breaks + row.breaks - was[1]
            largest = row.largest if largest is None else max(largest, row.largest)
            # an edge counts with the second of its two roles
            if row.low_role is not None and was[3] is None and (left := blocks.get(row.block - 1)):
                breaks += left[4] == row.low_role
            if row.high_role is not None and was[4] is None and (right := blocks.get(row.block + 1)):
                breaks += right[3] == row.high_role
            blocks.put(row.block, (row.n, row.breaks, row.run, row.low_role, row.high_role))
        from_ = next_
        while (at := blocks.get(next_ // BLOCK)) and at[2] is not None and at[2] >= next_:
            next_ = at[2] + 1
            if next_ % BLOCK:
                break
        blocks.write()
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + 1
        self.handle.registerTimer(timer)
        self.state.update((first, next_, batch, 0, timer, False, n, largest, breaks))
        if next_ > from_:
            yield _made("release", conv, from_, None, batch, next_ - 1, None, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, next_, last, silent, timer, closed, n, largest, breaks = self.state.get()
        silent += 1
        if silent < self.patience and last + silent != self.end:
            timer = timerValues.getCurrentProcessingTimeInMs() + 1
            self.handle.registerTimer(timer)
            self.state.update((first, next_, last, silent, timer, False, n, largest, breaks))
            return
        self.blocks.clear()
        self.state.update((first, next_, last, silent, None, True, n, largest, breaks))
        yield _made("close", key[0], None, None, last + silent, None, largest - first + 1 - n, breaks)

    def close(self) -> None:
        pass


class Reassembly:
    """A reassembly of n_batches batches. Feed the batches in order, then finish(); events() gives what came of them so far."""

    def __init__(self, spark: SparkSession, n_batches: int, patience: int = PATIENCE):
        self.spark, self.n_batches, self.patience, self.batch = spark, n_batches, patience, 0
        self.folder = f"{store.shared_dir(spark)}/turns-{uuid.uuid4().hex}"
        store.keep(spark, self.folder)

    def feed(self, df: DataFrame, conv_col: str = "conv_id") -> None:
        """The next batch: conv_col, turn, role, text, first (the smallest turn of the conversation)."""
        if self.batch >= self.n_batches:
            raise ValueError(f"all {self.n_batches} batches are fed")
        role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
        conv = F.coalesce(F.col(conv_col).cast("string"), F.lit(""))
        rows = df.where(F.col("turn").isNotNull()).select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("first").cast("long").alias("first"), F.struct(F.concat_ws("|", role, text).alias("payload"), role.alias("role"), text.alias("text")).alias("said"))
        least = rows.groupBy("conv", "turn").agg(F.min("first").alias("first"), F.min("said").alias("said"))
        self._run(least.select("conv", "turn", "first", F.lit(self.batch).alias("batch"), "said.*"))

    def finish(self) -> None:
        """The end: open conversations close."""
        if self.batch < self.n_batches:
            raise ValueError(f"{self.batch} of {self.n_batches} batches are fed")
        if self.batch == self.n_batches:
            self._run(self.spark.createDataFrame([], FED))

    def _run(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/fed")
        self._step()
        self.batch += 1

    def _step(self) -> None:
        """One micro-batch over what is new in the folder."""
        before = {k: self.spark.conf.get(k, None) for k in CONF}
        for k, v in CONF.items():
            self.spark.conf.set(k, v)
        try:
            fed = self.spark.readStream.schema(FED).parquet(f"{self.folder}/fed")
            narrow = fed.select("conv", F.shiftright("turn", BLOCK.bit_length() - 1).alias("block"), "turn", "first", "batch", "role")
            facts = narrow.groupBy("conv", "block").transformWithState(Blocks(), FACTS, "Append", "None")
            made = facts.groupBy("conv", "part").transformWithState(Conversations(self.n_batches, self.patience), MADE, "Append", "ProcessingTime")
            query = made.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{self.folder}/made")
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def events(self) -> DataFrame:
        """event, conv, turn, batch, role, text, payload of releases and rejects; of closings unreleased (kept turns), n_missing, n_breaks."""
        made = self.spark.read.schema(MADE).parquet(f"{self.folder}/made")
        fact = F.struct("turn", "upto", "batch", "n_missing", "n_breaks")
        # a conversation has a release for each batch and one closing at most; written, so that one of many turns is split by the join
        control = made.where("kind <> 'turn'").groupBy("conv").agg(F.collect_list(F.when(F.col("kind") == "release", fact)).alias("releases"), F.first(F.when(F.col("kind") == "close", fact), ignorenulls=True).alias("closing"))
        control = store.written(control, "control")
        within = F.filter("releases", lambda r: (r["turn"] <= F.col("turn")) & (F.col("turn") <= r["upto"]))
        turns = made.where("kind = 'turn'").join(control, "conv", "left").select("conv", "turn", "batch", "new", F.get(within, F.lit(0))["batch"].alias("released"), F.coalesce(F.col("batch") > F.col("closing.batch"), F.lit(False)).alias("late"))
        event = F.when(F.col("late"), "reject").when(F.col("new") & F.col("released").isNotNull(), "release").when(F.col("new"), "kept")
        turns = store.written(turns.withColumn("event", event).where("event IS NOT NULL"), "labels")
        fed = self.spark.read.schema(FED).parquet(f"{self.folder}/fed").select("conv", "turn", "batch", "role", "text", "payload")
        said = turns.where("event <> 'kept'").join(fed, ["conv", "turn", "batch"]).select("event", "conv", "turn", F.when(F.col("late"), F.col("batch")).otherwise(F.col("released")).alias("batch"), "role", "text", "payload")
        left = turns.where("event = 'kept'").groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("unreleased"))
        closed = control.where("closing IS NOT NULL").join(left, "conv", "left").select(F.lit("close").alias("event"), "conv", F.lit(-1).cast("long").alias("turn"), "closing.batch", F.coalesce("unreleased", F.array().cast("array<bigint>")).alias("unreleased"), "closing.n_missing", "closing.n_breaks")
        return said.unionByName(closed, allowMissingColumns=True)


def arrivals(df: DataFrame, n_batches: int = 12, conv_col: str = "conv_id") -> DataFrame:
    """df's turns dealt to batches by the hash of `conversation:turn`, two in seven arriving again three batches later with role user."""
    rows = df.where(F.col("turn").isNotNull()).select(conv_col, "turn", "role", "text")
    conv, (own, first) = F.coalesce(F.col(conv_col).cast("string"), F.lit("")), store.fresh(rows, "own_conv", "first")
    firsts = store.written(rows.groupBy(conv.alias(own)).agg(F.min("turn").alias(first)), "firsts")
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", conv, F.col("turn").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    dealt = rows.join(firsts, conv == F.col(own)).select(conv_col, "turn", "role", "text", F.col(first).alias("first"), h.alias("h"))
    own_batch, again = (F.col("h") % n_batches).cast("int"), ((F.col("h") + 3) % n_batches).cast("int")
    come = F.array(F.struct(own_batch.alias("batch"), F.col("role").alias("role")), F.when(F.col("h") % 7 < 2, F.struct(again.alias("batch"), F.lit("user").alias("role"))))
    return dealt.select(conv_col, "turn", "text", "first", F.explode(F.array_compact(come)).alias("a")).select(conv_col, "turn", "a.role", "text", "first", "a.batch")


def by_batch(df: DataFrame, n_batches: int) -> DataFrame:
    """df written to the shared folder by batch, a batch's rows spread over as many files as the session's partitions allow."""
    spark = df.sparkSession
    path = f"{store.shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    spread = int(spark.conf.get("spark.sql.shuffle.partitions")) // n_batches + 1
    dealt = df.repartition("batch", F.pmod(F.xxhash64("turn", "text"), F.lit(spread)))
    dealt.write.partitionBy("batch").parquet(path)
    store.keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)
