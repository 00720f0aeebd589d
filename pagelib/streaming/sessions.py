"""Browser session commands folded into tabs and windows.

A command is (session, seq, kind, tab, window, index, count, url, title, flag, token,
at). All fields but the navigation list are last-write-wins after a tab's last close
and fold by aggregation. Navigations depend on order, because prunes renumber them:
they are first compacted per stretch between prunes, then folded in sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagelib.functions import ordered, text
from pagelib.functions.ordered import Coarse

# Command names of the decoded log.
KINDS = ["tab_window", "tab_index", "navigation", "selected_navigation", "selected_tab", "window_type", "prune_back",
         "prune_front", "prune", "pinned", "tab_closed", "window_closed", "last_active", "tab_group", "group_meta", "marker"]
NAVIGATION = ["navigation", "selected_navigation", "prune_back", "prune_front", "prune"]
TAB_KEYS = ["session", "tab"]
STORED = "stored"      # the state of a tab or window before the commands of a batch


class Navigations:
    """The navigation list of one tab: entries by index and the selected index."""

    def __init__(self, entries: dict[int, tuple] | None = None, selected: int | None = None):
        self.entries, self.selected = entries or {}, selected

    def apply(self, kind: str, index: int, count: int, entry: tuple) -> None:
        if kind == "navigation":
            self.entries[index] = entry
        elif kind == "selected_navigation":
            self.selected = index
        elif kind == "prune_back":
            self.entries = {i: e for i, e in self.entries.items() if i < index}
        elif count > 0 and (kind == "prune_front" or index >= 0):
            start = 0 if kind == "prune_front" else index
            end = start + count
            moved = lambda i: i if i < start else i - count
            if self.selected is not None:
                self.selected = start - 1 if start <= self.selected < end else moved(self.selected)
            self.entries = {moved(i): e for i, e in self.entries.items() if not start <= i < end}

    def current(self) -> tuple:
        """(url, title, exact): the selected entry, else the next one, else the last."""
        if not self.entries:
            return None, None, None
        at = -1 if self.selected is None else self.selected
        if at in self.entries:
            return *self.entries[at], True
        later = [i for i in self.entries if i >= at]
        return *self.entries[min(later) if later else max(self.entries)], False


def _since_close(commands: DataFrame, keys: list[str], close: str) -> DataFrame:
    """Commands of a tab or window after its last close."""
    closed = commands.where(F.col("kind") == close).groupBy(*keys).agg(F.max("seq").alias("closed"))
    rest = commands.where((F.col("kind") != close) & F.col(keys[-1]).isNotNull())
    return rest.join(closed, keys, "left").where(F.col("closed").isNull() | (F.col("seq") > F.col("closed"))).drop("closed")


def _last(kind: str, value: Column) -> Column:
    at = F.when(F.col("kind") == kind, F.col("seq"))
    return F.max_by(F.struct(value.alias("v")), at)["v"]


def fold_navigations(commands: DataFrame) -> DataFrame:
    """(session, tab, url, title, exact) of every tab with navigation commands."""
    nav = commands.where(F.col("kind").isin(NAVIGATION))
    prune = F.when(F.col("kind").startswith("prune"), 1).otherwise(0).cast("long")
    staged = ordered.running(nav, TAB_KEYS, [F.col("seq")], [Coarse(ordered.id_bucket("seq", 1 << 16))], "stretch", prune)
    # Only the last write of an index (and of the selection) in a stretch can matter.
    slot = F.when(F.col("kind") == "navigation", F.col("index")).when(F.col("kind") == "selected_navigation", -1).otherwise(-2)
    kept = staged.groupBy(*TAB_KEYS, "stretch", slot.alias("slot"), "kind").agg(
        F.max_by(F.struct("index", "count", "url", "title"), "seq").alias("c"), F.max("seq").alias("seq"))
    kept = kept.select(*TAB_KEYS, "seq", "kind", "c.*").repartition(*TAB_KEYS).sortWithinPartitions(*TAB_KEYS, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Navigations()
        columns = ["session", "tab", "url", "title", "exact"]
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                if (r.session, r.tab) != key:
                    if key is not None:
                        done.append((*key, *state.current()))
                    key, state = (r.session, r.tab), Navigations()
                number = lambda v: 0 if pd.isna(v) else int(v)
                state.apply(r.kind, number(r.index_), number(r.count_), (r.url, r.title))
            if done:
                yield pd.DataFrame(done, columns=columns)
        if key is not None:
            yield pd.DataFrame([(*key, *state.current())], columns=columns)

    kinds = dict(commands.dtypes)
    return kept.withColumnsRenamed({"index": "index_", "count": "count_"}).mapInPandas(
        run, f"session {kinds['session']}, tab {kinds['tab']}, url string, title string, exact boolean")


def session_fold(commands: DataFrame) -> dict[str, DataFrame]:
    """Tables tabs, windows, groups and stats of every session."""
    live = _since_close(commands, TAB_KEYS, "tab_closed")
    fields = live.groupBy(*TAB_KEYS).agg(
        _last("tab_window", F.col("window")).alias("window_id"), _last("tab_index", F.col("index")).alias("position"),
        _last("pinned", F.col("flag")).alias("pinned"), _last("last_active", F.col("at")).alias("last_active"),
        _last("tab_group", F.when(F.col("flag"), F.col("token"))).alias("group"))
    tabs = fields.join(fold_navigations(live), TAB_KEYS, "left")
    on_window = commands.where(F.col("window").isNotNull())
    types = on_window.where(F.col("kind").isin("window_type", "window_closed")).groupBy("session", "window").agg(
        F.max_by(F.struct("kind", "index"), "seq").alias("w"))
    open_windows = types.where(F.col("w.kind") == "window_type").select("session", "window", F.col("w.index").alias("kind_id"))
    # Windows of one session: numbered by id.
    numbered = ordered.row_number(open_windows, ["session"], [F.col("window")], [Coarse(ordered.id_bucket("window", 1024))], "number")
    closed = types.where(F.col("w.kind") == "window_closed").select("session", F.col("window").alias("window_id"), F.lit(True).alias("was_closed"))
    placed = (tabs.join(numbered.select("session", F.col("window").alias("window_id"), "number"), ["session", "window_id"], "left")
              .join(closed, ["session", "window_id"], "left"))
    drop = (F.when(F.col("number").isNull(), F.when(F.col("was_closed"), "window_closed").otherwise("window_missing"))
            .when(F.col("url").isNull(), "no_navigations"))
    placed = placed.withColumn("dropped", drop)
    kept = placed.where(F.col("dropped").isNull()).withColumn("position", F.coalesce("position", F.lit(-1)))
    unknown = F.col("position") < 0
    kept = ordered.row_number(kept, ["session", "number"], [F.col("position"), F.col("tab")],
                              [Coarse(~unknown), Coarse(F.when(unknown, ordered.id_bucket("tab")).otherwise(ordered.id_bucket("position", 64)))],
                              "place")
    chosen = commands.where(F.col("kind") == "selected_tab").groupBy("session", "window").agg(F.max_by("index", "seq").alias("selected"))
    sizes = kept.groupBy("session", "number").agg(F.count(F.lit(1)).alias("tabs"))
    windows = numbered.join(sizes, ["session", "number"], "left").join(chosen, ["session", "window"], "left").withColumn(
        "front", F.when(F.col("selected").isNotNull(), F.greatest(F.lit(1).cast("long"), F.least(F.greatest("selected", F.lit(0)) + 1, F.col("tabs")))))
    front = windows.select("session", "number", F.col("front"))
    kept = kept.join(front, ["session", "number"], "left").withColumn("active", F.coalesce(F.col("place") == F.col("front"), F.lit(False)))
    active = kept.where("active").select("session", "number", F.col("tab").alias("active_tab"))
    windows = windows.join(active, ["session", "number"], "left").select(
        "session", "number", "window", text.decode_kind("kind_id").alias("kind"), F.coalesce("tabs", F.lit(0)).alias("tabs"), "active_tab")
    meta = commands.where(F.col("kind") == "group_meta").groupBy("session", F.col("token").alias("group")).agg(
        F.max_by(F.struct("title", "index", "flag"), "seq").alias("m"))
    groups = kept.where(F.col("group").isNotNull()).groupBy("session", "group").agg(F.min_by("number", "tab").alias("number"))
    groups = groups.join(meta, ["session", "group"], "left").select(
        "session", "group", "number", F.col("m.title").alias("title"), text.decode_colour("m.index").alias("colour"),
        F.coalesce("m.flag", F.lit(False)).alias("collapsed"))
    out = kept.select("session", "tab", F.col("number").alias("window"), "position", "url", "title", F.coalesce("pinned", F.lit(False)).alias("pinned"),
                      "active", "group", "last_active", "exact")
    dropped = placed.where(F.col("dropped").isNotNull()).groupBy("session").agg(
        *[F.count(F.when(F.col("dropped") == r, 1)).alias(r) for r in ("no_navigations", "window_missing", "window_closed")])
    counts = kept.groupBy("session").agg(F.count(F.lit(1)).alias("tabs"), F.count(F.when(~F.col("exact"), 1)).alias("navigation_fallbacks"))
    seen = commands.groupBy("session").agg(
        F.count(F.lit(1)).alias("commands"), F.count(F.when(F.col("kind") == "marker", 1)).alias("marker_count"),
        F.count(F.when(~F.col("kind").isin(KINDS), 1)).alias("unknown_commands"))
    bare = groups.where(F.col("title").isNull()).groupBy("session").agg(F.count(F.lit(1)).alias("groups_without_metadata"))
    stats = seen.join(counts, "session", "left").join(dropped, "session", "left").join(bare, "session", "left").na.fill(0)
    return {"tabs": out, "windows": windows, "groups": groups, "stats": stats}


class _Item:
    """A tab's window and navigation list, or whether a window is open, as its commands say in their order."""

    def __init__(self):
        self.nav, self.window, self.seq, self.open = Navigations(), None, -1, False

    def apply(self, r) -> None:
        number = lambda v: 0 if pd.isna(v) else int(v)
        if r.kind == STORED:
            saved = json.loads(r.fold)
            self.nav = Navigations({int(i): tuple(e) for i, e in saved["e"].items()}, saved["s"])
            self.window, self.seq, self.open = saved["w"], int(r.seq), saved["o"]
        elif r.seq > self.seq:
            self.seq = int(r.seq)
            self.open = r.kind not in ("tab_closed", "window_closed")
            if not self.open:
                self.nav, self.window = Navigations(), None
            elif r.kind == "tab_window":
                self.window = None if pd.isna(r.window) else int(r.window)
            elif r.kind in NAVIGATION:
                self.nav.apply(r.kind, number(r.index_), number(r.count_), (r.url, r.title))

    def row(self) -> tuple:
        # A closed tab keeps only its last number, to know commands that come again.
        fold = json.dumps({"e": self.nav.entries, "s": self.nav.selected, "w": self.window, "o": self.open})
        return self.seq, self.window, *self.nav.current(), self.open, fold


def tab_stream(commands: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Current page of every open tab, continuously: (session, tab, window, url, title, exact).

    A tab's state is its navigation list, which the browser bounds, and its window; a
    window's state is whether it is open. Tabs of a window that is closed or was never
    opened are left out, as in `session_fold`, also where the window closes later than the
    tab's last command. Commands of a tab or window come in order of `seq` from one batch
    to the next, as a log grows; those that come again are ignored.

    A batch puts the stored states of the tabs and windows it names before their commands, sorts both by key and folds
    them in one pass over a task's rows, however many keys it has. The new states go to the batch's own folder, so a
    repeated batch replaces itself.
    """
    spark = commands.sparkSession
    keys = ["session", "item", "id"]
    names = ["seq", "window", "url", "title", "exact", "open", "fold"]
    schema = "session long, item string, id long, seq long, window long, url string, title string, exact boolean, open boolean, fold string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, item = None, _Item()
        frame = lambda rows: pd.DataFrame(rows, columns=keys + names).astype({"window": "Int64"})
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                if (r.session, r.item, r.id) != key:
                    if key is not None:
                        done.append((*key, *item.row()))
                    key, item = (r.session, r.item, r.id), _Item()
                item.apply(r)
            if done:
                yield frame(done)
        if key is not None:
            yield frame([(*key, *item.row())])

    def stored(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")

    # A command without a session belongs to no window.
    of_tab = F.col("kind").isin(NAVIGATION + ["tab_window", "tab_closed"]) & F.col("tab").isNotNull()
    of_window = F.col("kind").isin("window_type", "window_closed") & F.col("window").isNotNull()
    wanted = commands.where((of_tab | of_window) & F.col("session").isNotNull()).select(
        "session", F.when(of_tab, "tab").otherwise("window").alias("item"), F.when(of_tab, F.col("tab")).otherwise(F.col("window")).alias("id"),
        "seq", "kind", "window", F.col("index").alias("index_"), F.col("count").alias("count_"), "url", "title")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("fold", F.lit(None).cast("string"))
        if batch_id > 0:
            # Batches after this one are there only if it is repeated.
            before = spark.read.schema(schema + ", batch long").parquet(out).where(F.col("batch") < batch_id)
            before = stored(before.join(batch.select(*keys).distinct(), keys, "left_semi"), ["seq", "fold"])
            rows = rows.unionByName(before.withColumn("kind", F.lit(STORED)), allowMissingColumns=True)
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc(F.col("kind") == STORED), "seq")
        dealt.mapInPandas(run, schema).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (wanted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    last = stored(spark.read.schema(schema + ", batch long").parquet(out), names[1:-1]).where("open")
    windows = last.where("item = 'window'").select("session", F.col("id").alias("window"))
    return (last.where("item = 'tab' AND url IS NOT NULL").withColumnRenamed("id", "tab").join(windows, ["session", "window"], "left_semi")
            .select("session", "tab", "window", "url", "title", "exact"))
