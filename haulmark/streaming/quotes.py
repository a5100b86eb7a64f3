"""The request feed as a stream: dedupe, thread state, decision per micro-batch, running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from haulmark.config import QuotingConfig
from haulmark.functions.requests import VOLUME, is_ignored_sender
from haulmark.operators.routing import route_requests
from haulmark.operators.tariffs import SENSITIVE, apply_quarantine, audit_tariffs, diff_snapshots, fingerprint
from haulmark.session import free, written

REQUEST_SCHEMA = (
    "id_email long, thread_id long, ts timestamp, remetente string, e_cotacao boolean, confianca double, origem string, "
    f"destino string, qtd_volumes int, valor_nf double, peso_kg double, volumes array<{VOLUME}>, m3_informado double, modal string"
)
DECISION_COLUMNS = ["id_email", "thread_id", "ts", "outcome", "label", "reason", "quoted_total", "quoted_tariff"]


def read_requests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be decided, and those without id, thread or time, with the reason."""
    problem = (
        F.when(F.col("id_email").isNull(), "no id").when(F.col("thread_id").isNull(), "no thread").when(F.col("ts").isNull(), "no time")
    )
    marked = df.withColumn("reject_reason", problem)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


STATE_TTL_MS = 30 * 24 * 3600 * 1000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(df: DataFrame, watermark: str) -> DataFrame:
    """A feed whose event time moves the watermark, but whose late rows are kept.

    Spark drops late rows by the column that carries the watermark. The operators behind get a copy
    of the time instead, see the watermark through their timers, and say themselves what is late.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    # A batch without data would only run the timers; state past its time counts as none when it is read.
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    copy = F.timestamp_micros(F.unix_micros("ts"))
    return df.withColumn("_clock", F.col("ts")).withWatermark("_clock", watermark).withColumn("ts", copy).drop("_clock")


def _group(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS))


def _milliseconds(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


#: Ids and threads are remembered in this many groups: Python is entered once a group and batch instead of once a key.
GROUPS = 256
_DAY_MS = 24 * 3600 * 1000


class _Grouped(StatefulProcessor):
    """The rows of many keys come together; ``held`` is a map state by key whose values end with the newest time.

    Only keys of the batch are looked up. One timer per group, at most one a day of event time, removes the keys
    past their time to live.
    """

    def _sweep_by(self, oldest: int) -> None:
        """A timer at the end of the day on which the oldest key ends, unless one comes before."""
        at = (int(oldest) + STATE_TTL_MS) // _DAY_MS * _DAY_MS + _DAY_MS
        planned = self.sweep.get()[0] if self.sweep.exists() else None
        if planned is None or at < planned:
            if planned is not None:
                self.handle.deleteTimer(planned)
            self.handle.registerTimer(at)
            self.sweep.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        newest = [(name, value[-1]) for name, value in self.held.iterator()]
        for name, at in newest:
            if at + STATE_TTL_MS <= mark:
                self.held.removeKey(name)
        self.sweep.clear()
        left = [at for _, at in newest if at + STATE_TTL_MS > mark]
        if left:
            self._sweep_by(min(left))
        return iter([])


class FirstSeen(_Grouped):
    """Lets the first record of an id pass; repeats are dropped until the id has been silent for the time to live."""

    def __init__(self, columns: list[str], key: str) -> None:
        self.columns, self.key = columns, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("seen", "id string", "newest long")
        self.sweep = handle.getValueState("sweep", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        # Each frame shrinks to one row an id, so repeats of one id do not pile up.
        frames, newest = [], []
        for frame in rows:
            frames.append(frame.sort_values("ts", kind="stable").drop_duplicates(self.key))
            newest.append(_milliseconds(frame["ts"]).groupby(frame[self.key].to_numpy()).max())
        first = pd.concat(frames).sort_values("ts", kind="stable").drop_duplicates(self.key)
        newest = pd.concat(newest).groupby(level=0).max().clip(lower=mark).to_dict()
        fresh, known = [], self.held.exists()
        for i in first[self.key].tolist():
            name, at = (str(i),), int(newest[i])
            before = self.held.getValue(name) if known else None
            fresh.append(before is None or before[0] + STATE_TTL_MS <= mark)
            self.held.updateValue(name, (at if fresh[-1] else max(at, before[0]),))
        self._sweep_by(min(newest.values()))
        first = first[fresh]
        if len(first):
            late = _milliseconds(first["ts"]) < mark
            yield first.assign(reject_reason=late.map({True: "late", False: None}))[self.columns]


def dedupe_stream(df: DataFrame, key: str = "id_email", watermark: str = "7 days") -> DataFrame:
    """One record per id. Records behind the watermark stay, with reason ``late``; bad ones too, with theirs."""
    good, bad = split_rejects(df)
    schema = T.StructType([*good.schema.fields, T.StructField("reject_reason", T.StringType())])
    grouped = _timed(good, watermark).withColumn("_group", _group(key)).groupBy("_group")
    made = grouped.transformWithStateInPandas(FirstSeen(schema.names, key), schema, "Append", "EventTime")
    return made.unionByName(bad)


# The package list travels through the state as JSON; an empty one counts as not given.
_FIELDS = ["origem", "destino", "qtd_volumes", "valor_nf", "peso_kg", "m3_informado", "modal", "volumes"]
_FIELD_TYPES = "origem string, destino string, qtd_volumes int, valor_nf double, peso_kg double, m3_informado double, modal string, volumes string"
_STATE = f"{_FIELD_TYPES}, confianca double, heard array<long>, heard_at array<long>, newest long"
_PASSED = ["id_email", "thread_id", "ts", "remetente", "e_cotacao", "confianca", *_FIELDS]
_THREAD_OUT = (
    f"id_email long, thread_id long, ts timestamp, remetente string, e_cotacao boolean, confianca double, {_FIELD_TYPES}, reject_reason string"
)


def _given(values: pd.Series) -> pd.Series:
    """Zero, empty text and missing values count as not given."""
    return values.notna() & (values != 0) & (values != "")


class ThreadMemory(_Grouped):
    """Completes each message with what its thread said before; the newest given value wins.

    The state of a thread keeps its fields and the ids heard lately, so a repeat tells nothing twice. A message
    behind the watermark comes out as ``late`` and leaves the thread as it is. A thread that has been silent for
    thirty days of event time is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("known", "thread_id long", _STATE)
        self.sweep = handle.getValueState("sweep", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        # The messages of the threads of a group within one micro-batch.
        batch = pd.concat(list(rows)).sort_values(["thread_id", "ts", "id_email"], ignore_index=True)
        threads = [int(t) for t in batch["thread_id"].unique()]
        known = self._remembered(threads, mark)
        heard = {t: dict(zip(state[-3] or [], state[-2] or [], strict=True)) for t, state in known.items()}
        again = pd.Series([i in heard.get(t, ()) for t, i in zip(batch["thread_id"].tolist(), batch["id_email"].tolist(), strict=True)], dtype=bool)
        batch["_at"] = _milliseconds(batch["ts"])
        late = batch["_at"] < mark
        again |= batch.assign(_late=late).duplicated(["thread_id", "id_email", "_late"]) & ~late
        batch, late = batch[~again], late[~again]
        after = self._complete(batch, ~late & batch["listens"].astype(bool), known)
        fresh = batch[~late]
        for t, i, at in zip(fresh["thread_id"].tolist(), fresh["id_email"].tolist(), fresh["_at"].tolist(), strict=True):
            heard.setdefault(t, {})[i] = at
        newest = fresh.groupby("thread_id")["_at"].max().to_dict()
        ends = []
        for t in threads:
            # Ids behind the watermark would only come again as late ones, which the log of decisions catches.
            lately = {int(i): int(at) for i, at in heard.get(t, {}).items() if at >= mark}
            ends.append(max(known[t][-1] if t in known else 0, int(newest.get(t, 0)), mark))
            said = after[t] if t in after else known[t][:-3] if t in known else [None] * (len(_FIELDS) + 1)
            self.held.updateValue((t,), (*said, list(lately), list(lately.values()), ends[-1]))
        self._sweep_by(min(ends))
        if len(batch):
            result = batch.assign(reject_reason=late.map({True: "late", False: None}))[[*_PASSED, "reject_reason"]]
            yield result.astype({"qtd_volumes": "Int32", "valor_nf": "float64", "peso_kg": "float64", "m3_informado": "float64"})

    def _remembered(self, threads: list[int], mark: int) -> dict[int, list]:
        if not self.held.exists():
            return {}
        found = {t: self.held.getValue((t,)) for t in threads}
        return {t: list(state) for t, state in found.items() if state is not None and state[-1] + STATE_TTL_MS > mark}

    @staticmethod
    def _complete(batch: pd.DataFrame, tells: pd.Series, known: dict[int, list]) -> dict[int, list]:
        """Fill the batch in place; what each of its threads has said by then."""
        thread, takes, last = batch["thread_id"], tells & batch["e_cotacao"].astype(bool), {}
        for n, f in enumerate(_FIELDS):
            own = batch[f].astype(object)
            said = own.where(tells & _given(own)).groupby(thread).ffill()
            before = thread.map({t: state[n] for t, state in known.items() if state[n] is not None}).astype(object)
            last[f] = said.where(said.notna(), before)
            filled = own.where(~(takes & last[f].notna()), last[f])
            batch[f] = filled.where(filled.notna(), None)
        sure = pd.to_numeric(batch["confianca"]).astype("float64")
        start = thread.map({t: state[len(_FIELDS)] or 0.0 for t, state in known.items()}).astype("float64").fillna(0.0)
        surest = sure.where(tells & _given(sure), 0.0).groupby(thread).cummax().clip(lower=start)
        batch["confianca"] = sure.where(~takes, surest)
        ends = pd.DataFrame(last).assign(confianca=surest).groupby(thread).tail(1)
        plain = ends.astype(object).where(ends.notna(), None)
        if "qtd_volumes" in plain:
            plain["qtd_volumes"] = [None if v is None else int(v) for v in plain["qtd_volumes"]]
        return {int(t): list(v) for t, v in zip(thread.loc[ends.index], plain.itertuples(index=False), strict=True)}


def thread_state(df: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Streaming twin of the thread merge. No record is lost: ``reject_reason`` says why one cannot be decided.

    It is null for completed messages, ``late`` behind the watermark, and names what is missing in
    records without id, thread or time, which never reach the state.
    """
    good, bad = split_rejects(df)
    listed = F.when(F.size("volumes") > 0, F.to_json("volumes"))
    listens = ~is_ignored_sender("remetente", QuotingConfig().own_address)
    good = good.withColumns({"volumes": listed, "listens": listens}).select(*_PASSED, "listens")
    grouped = _timed(good, watermark).withColumn("_group", _group("thread_id")).groupBy("_group")
    merged = grouped.transformWithStateInPandas(ThreadMemory(), _THREAD_OUT, "Append", "EventTime")
    merged = merged.withColumn("volumes", F.from_json("volumes", f"array<{VOLUME}>"))
    return merged.unionByName(bad.select(*_PASSED, "reject_reason"))


# ---------------------------------------------------------------- tariffs as they are at each batch


class TariffStore:
    """Snapshots of the tariff table by content, their history by batch, and what changed from one to the next.

    A content is written once. The latest and the one before it are kept; older ones are freed. The audit of the
    latest table is kept too, so a batch that finds the tariffs unchanged does not audit them again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def snapshot(self, content: str) -> DataFrame:
        fields = ", ".join(f"`{c}` string" for c in ("key", *SENSITIVE, "row_hash"))
        return self.spark.read.schema(fields).parquet(f"{self.folder}/snapshots/content={content}")

    def history(self) -> DataFrame:
        return self.spark.read.schema("batch long, content string, tariffs long").parquet(f"{self.folder}/history")

    def audited(self, tariffs: DataFrame, enforce: bool = True) -> DataFrame:
        """The tariffs with their quarantine, from the last audit if every column of every row is as it was."""
        row = F.xxhash64(*tariffs.columns, *[F.col(c).isNull() for c in tariffs.columns]).cast("decimal(38,0)")
        whole = tariffs.agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("h")).first()
        path = f"{self.folder}/audited/content={whole['n']}_{whole['h'] or 0}_{enforce}"
        fresh = apply_quarantine(tariffs, audit_tariffs(tariffs), enforce)
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            free(self.spark, [f"{self.folder}/audited"])
            fresh.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(fresh.schema).parquet(path)

    def record(self, prints: DataFrame, batch_id: int) -> str:
        """Store the content seen by a batch, and its changes against the content of the batch before."""
        rows = prints.agg(F.count("*").alias("n"), F.sum(F.xxhash64("row_hash").cast("decimal(38,0)")).cast("string").alias("h")).first()
        content = f"{rows['n']}_{rows['h'] or 0}"
        earlier = []
        if _exists(self.spark, f"{self.folder}/history"):
            earlier = [r["content"] for r in self.history().filter(F.col("batch") < batch_id).orderBy(F.desc("batch")).limit(KEPT_VERSIONS).collect()]
        if not _exists(self.spark, f"{self.folder}/snapshots/content={content}"):
            prints.write.mode("overwrite").parquet(f"{self.folder}/snapshots/content={content}")
        if earlier and earlier[0] != content:
            changes = diff_snapshots(self.snapshot(earlier[0]), self.snapshot(content))
            changes.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")
        entry = self.spark.range(1).select(F.lit(content).alias("content"), F.lit(rows["n"]).cast("long").alias("tariffs"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/history/batch={batch_id}")
        kept = {content, *earlier[:1]}
        free(self.spark, [f"{self.folder}/snapshots/content={c}" for c in earlier[1:] if c not in kept])
        return content


#: Versions looked back at when old snapshots are freed.
KEPT_VERSIONS = 50


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def with_tariffs(loader: Callable[[], DataFrame], store: TariffStore, enforce: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Load the tariffs as they are now, with their audit and fingerprint, and the paths to free after the batch."""
    tariffs, raw = written(loader())
    return store.audited(tariffs, enforce), fingerprint(tariffs), [raw]


# ---------------------------------------------------------------- ids of decided requests as an index

#: Rows of the filter of a day, of 64 bits each: two bits of one row stand for an id.
DAY_SLOTS = 4096


def _place(id_: str) -> dict[str, Column]:
    h = F.xxhash64(id_, F.lit(3))
    bit = lambda by: F.call_function("shiftleft", F.expr("1L"), F.pmod(F.shiftright(h, by), F.lit(64)).cast("int"))
    return {"slot": F.pmod(h, F.lit(DAY_SLOTS)).cast("int"), "mask": bit(20).bitwiseOR(bit(40))}


def day_filters(decisions: DataFrame) -> DataFrame:
    """``day, slot, bits``: which ids were decided on a day, folded by ``bit_or``; at most ``DAY_SLOTS`` rows a day."""
    return decisions.withColumns(_place("id_email")).groupBy("day", "slot").agg(F.bit_or("mask").alias("bits"))


class DecisionLog:
    """Decisions by day and batch, with a filter per day that says where an id may have been decided.

    The filters of all days let few ids through; only the days they name are read, and only there
    ids are compared.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def decided(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/decisions")

    def before(self, ids: DataFrame, batch_id: int) -> DataFrame | None:
        """Those of ``ids`` that another batch has decided; null when there is surely none."""
        if not _exists(self.spark, f"{self.folder}/filters"):
            return None
        filters = self.spark.read.schema("slot int, bits long, day string, batch long").parquet(f"{self.folder}/filters")
        filters = filters.filter(F.col("batch") != batch_id).groupBy("day", "slot").agg(F.bit_or("bits").alias("bits"))
        asked = ids.select("id_email").distinct().withColumns(_place("id_email"))
        maybe = asked.join(filters, "slot").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("id_email", "day")
        days = [r["day"] for r in maybe.select("day").distinct().collect()]  # at most the days of the log
        if not days:
            return None
        schema = "id_email long, day string, batch long"
        there = self.spark.read.schema(schema).parquet(f"{self.folder}/decisions").filter(F.col("day").isin(days) & (F.col("batch") != batch_id))
        return maybe.join(there.select("id_email", "day"), ["id_email", "day"], "left_semi").select("id_email").distinct()

    def append(self, decided: DataFrame, batch_id: int) -> None:
        """Write a batch; running it again overwrites what it wrote."""
        marked = decided.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "batch": F.lit(batch_id).cast("long")})
        # By day, so a day gets few files instead of one of each task; a crowded day is split.
        parts = marked.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
        parts.parquet(f"{self.folder}/decisions")
        mine = self.spark.read.schema("id_email long, day string, batch long").parquet(f"{self.folder}/decisions").filter(F.col("batch") == batch_id)
        rows = day_filters(mine).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.folder}/filters")


def start_quote_stream(
    requests: DataFrame, loader: Callable[[], DataFrame], out: str, checkpoint: str, day: str,
    cfg: QuotingConfig = QuotingConfig(), trigger: dict | None = None,
) -> StreamingQuery:
    """Decide every request of the feed: each id ends up once, in ``decisions`` or in ``rejects``.

    A batch writes its own partitions and overwrites them when the batch is run again, and
    ids other batches decided are left out, so a replay changes nothing. Tariffs are loaded once per
    batch, and ``tariffs/changes`` holds what changed since the batch before.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log, store = DecisionLog(spark, out), TariffStore(spark, f"{out}/tariffs")
        # Written once: the state behind the batch would run as often as it is read.
        batch, path = written(batch)
        if "reject_reason" in batch.columns:
            good, bad = batch.filter("reject_reason IS NULL").drop("reject_reason"), batch.filter("reject_reason IS NOT NULL")
        else:
            good, bad = split_rejects(batch)
        good = good.dropDuplicates(["id_email"])
        audited, prints, paths = with_tariffs(loader, store)
        store.record(prints, batch_id)
        earlier = log.before(batch.filter("id_email IS NOT NULL"), batch_id)
        if earlier is not None:
            good = good.join(earlier, "id_email", "left_anti")
            bad = bad.join(earlier, "id_email", "left_anti")
        log.append(route_requests(good, audited, day, cfg, paths=paths).select(*DECISION_COLUMNS), batch_id)
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        free(spark, [path, *paths])

    writer = requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def outcome_counts_stream(decisions: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Running counts by UTC day and outcome; use with update mode."""
    return (
        decisions.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("day"), "outcome")
        .agg(F.count("*").alias("n"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "outcome", "n")
    )

