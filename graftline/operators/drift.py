"""Schema changes between the successive files of a feed, from rescue-column ingestion.

Lines are ingested once, into a table in the shared folder. Its ``_paths`` become one row per file and path with the
set of kinds (an aggregation that combines map-side, so its shuffle holds files x paths and not lines). A path that
went and one that came under the same holder with the same kinds is a possible rename. Evidence comes from the ingested
rows of such files only: a field that was renamed stands in the typed columns on one side and in the rescue column on the
other, or in the rescue column on both. The values of the records that both files hold are compared by hash; a rename
needs at least one value present in both files and none that differs. Fields of an object that only one of the two files
gives are no difference. Last, the changes of a feed are told from top to bottom over its small table of paths. The
renames of the report are the names by which ``samples`` promotes rescued values into the typed columns.

Defined cases: lines that are no JSON object count for nothing; a file that is missing in the sequence (no line of it
parses) is skipped as if it had no paths: the next file is not compared, as there is no file with the previous number; several possible renames
of one path go to the one with most records in common, then to the first in code-point order; null feed or sequence
numbers are left out; null record ids give no evidence.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.operators.rescue import APPROVED, TARGET, approvals, ingest, promote, values
from graftline.runtime import Scratch


def holder(path: str) -> str:
    """``messages[]`` of ``messages[].depth``; nothing for a top-level key."""
    return path.rpartition(".")[0]


def below(path: str, top: str) -> bool:
    return path.startswith((f"{top}.", f"{top}["))


def file_paths(ingested: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, path, kinds) of every file."""
    each = ingested.where("feed IS NOT NULL AND file_seq IS NOT NULL").select("feed", "file_seq", "file_name", F.explode("_paths").alias("entry"))
    kind, path = F.substring_index("entry", " ", 1).cast("int"), F.expr("substring(entry, instr(entry, ' ') + 1)")
    # the least name of a file's lines is taken from the few rows that are left, as it would make the first step sort
    named = each.groupBy("feed", "file_seq", "file_name", path.alias("path")).agg(F.bit_or(kind).alias("kinds"))
    return named.groupBy("feed", "file_seq", "path").agg(F.min("file_name").alias("file_name"), F.bit_or("kinds").alias("kinds"))


def _possible(old: dict[str, int], new: dict[str, int]) -> list[tuple[str, str]]:
    """(gone, come) pairs that may be renames, those inside possibly renamed holders included."""
    found: list[tuple[str, str]] = []
    gone = sorted((p for p in old if p not in new), key=len)
    come = sorted((p for p in new if p not in old), key=len)
    for g in gone:
        if g.endswith("[]"):
            continue
        for c in come:
            if not c.endswith("[]") and old[g] == new[c]:
                a, b = holder(g), holder(c)
                if a == b or any(a == x + a[len(x):] and b == y + a[len(x):] and (a == x or below(a, x)) for x, y in found):
                    found.append((g, c))
    return found


def _candidates(batches: pd.DataFrame) -> pd.DataFrame:
    files = defaultdict(dict)
    for seq, path, kinds in zip(batches["file_seq"], batches["path"], batches["kinds"]):
        files[seq][path] = kinds
    rows = [(batches["feed"].iloc[0], seq, g, c) for seq in files if seq - 1 in files for g, c in _possible(files[seq - 1], files[seq])]
    return pd.DataFrame(rows, columns=["feed", "file_seq", "old_path", "new_path"])


def _top(path: str) -> str:
    """The top-level key of a path."""
    return path.partition(".")[0].partition("[")[0]


def _asked(wants: str) -> tuple[list[dict], frozenset[str]]:
    """What is wanted of a file's lines, and the top-level keys under which it stands."""
    read = json.loads(wants)
    return read, frozenset(_top(w["at"]) for w in read)


def _values(wanted: DataFrame, ingested: DataFrame) -> DataFrame:
    """(feed, pair_seq, old_path, new_path, record_id, side, rel, value): the scalar values at the wanted paths."""
    sides = wanted.select("feed", F.col("file_seq").alias("pair_seq"), "old_path", "new_path", F.explode(F.array(
        F.struct((F.col("file_seq") - 1).cast("int").alias("file_seq"), F.lit(0).alias("side"), F.col("old_path").alias("at")),
        F.struct(F.col("file_seq").cast("int").alias("file_seq"), F.lit(1).alias("side"), F.col("new_path").alias("at")),
    )).alias("s")).select("feed", "s.file_seq", F.struct("pair_seq", "old_path", "new_path", "s.side", "s.at").alias("want"))
    per_file = sides.groupBy("feed", "file_seq").agg(F.to_json(F.collect_list("want")).alias("wants"))  # bounded by the paths of a file
    hit = ingested.where("record_id IS NOT NULL AND _status = 'ok'").select("feed", "file_seq", "record_id", *TARGET, "_rescued", "_written").join(per_file, ["feed", "file_seq"])
    fields = {"feed": pa.string(), "pair_seq": pa.int32(), "old_path": pa.string(), "new_path": pa.string(), "record_id": pa.string(), "side": pa.int32(), "rel": pa.string(), "value": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lru_cache(maxsize=1024)(_asked)  # the same for all lines of a file
            asked = [read(x) for x in batch.column("wants").to_pylist()]
            every = frozenset().union(*(tops for _, tops in asked))
            typed = {k: batch.column(k).to_pylist() for k in TARGET if k in every}
            rescued, written, feeds, records = (batch.column(c).to_pylist() for c in ("_rescued", "_written", "feed", "record_id"))
            rows = []
            for n, (wants, tops) in enumerate(asked):
                kept = {k: v for k, v in json.loads(rescued[n]).items() if _top(k) in tops} if rescued[n] else {}
                held = values({k: x[n] for k, x in typed.items() if k in tops}, kept, json.loads(written[n]) if written[n] else {})
                flat = [(path, where, v) for path, _, where, v in held if not isinstance(v, dict | list)]
                for w in wants:
                    at = w["at"]
                    for path, where, v in flat:
                        if path == at or below(path, at):
                            rel = f"{path[len(at):]} {where}"
                            rows.append((feeds[n], w["pair_seq"], w["old_path"], w["new_path"], records[n], w["side"], rel, xxhash.xxh3_64_intdigest(json.dumps(v)) - 2**63))
            cells = list(zip(*rows)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, fields.values())], list(fields))

    return hit.mapInArrow(run, "feed string, pair_seq int, old_path string, new_path string, record_id string, side int, rel string, value bigint")


def _renames(wanted: DataFrame, ingested: DataFrame) -> DataFrame:
    """(feed, file_seq, old_path, new_path, records): the pairs whose shared records all agree."""
    key = ["feed", "pair_seq", "old_path", "new_path", "record_id", "rel"]
    sides = _values(wanted, ingested).groupBy(*key, "value").agg(F.bit_or(F.col("side") + 1).alias("on"))  # 1 old, 2 new, 3 both
    one = sides.groupBy(*key).agg(F.bit_or("on").alias("sides"), F.max(F.col("on") == 3).alias("same"))
    # repeated lines of a record may differ; one value that both sides hold is enough to agree
    both = one.where("sides = 3")
    counted = both.groupBy("feed", "pair_seq", "old_path", "new_path").agg(F.count("*").alias("records"), F.count_if(~F.col("same")).alias("other"))
    return counted.where("other = 0").select("feed", F.col("pair_seq").alias("file_seq"), "old_path", "new_path", "records")


def compare(old: dict[str, int], new: dict[str, int], renames: dict[tuple[str, str], int]) -> list[tuple[str, str, str]]:
    """(drift, field_path, old_path) between two files' paths."""
    renamed: dict[str, str] = {}  # new path to old path
    taken: set[str] = set()
    for (g, c), _ in sorted(renames.items(), key=lambda x: (x[0][0].count(".") + x[0][0].count("["), -x[1], x[0])):
        a, b = holder(g), holder(c)
        if c in renamed or g in taken:
            continue
        if _as_old(c, renamed) in old or _as_old(g, {v: k for k, v in renamed.items()}) in new:  # only its holder was renamed
            continue
        if a == b or _as_old(b, renamed) == a:
            renamed[c] = g
            taken.add(g)
    out = [("renamed", c, g) for c, g in renamed.items()]
    as_old = {p: _as_old(p, renamed) for p in new}
    closed: list[str] = []  # new-side names below which nothing is told
    for p in sorted(new, key=len):
        if p in renamed or any(below(p, x) for x in closed):
            continue
        before = old.get(as_old[p])
        if before is None:
            out.append(("added", p, ""))
            closed.append(p)
        elif before != new[p]:
            out.append(("retyped", p, ""))
            closed.append(p)
    have = set(as_old.values())
    shut = [as_old[x] for x in closed]
    for p in sorted(old, key=len):
        if p not in have and not any(below(p, x) for x in shut):
            out.append(("removed", p, ""))
            shut.append(p)
    return out


def _as_old(path: str, renamed: dict[str, str]) -> str:
    """The path as it was called before the renames, of the longest renamed part."""
    best = max((c for c in renamed if path == c or below(path, c)), key=len, default=None)
    return path if best is None else renamed[best] + path[len(best):]


def _report(key: tuple, paths: pd.DataFrame, renames: pd.DataFrame) -> pd.DataFrame:
    files: dict = defaultdict(dict)
    names: dict = {}
    for seq, name, path, kinds in zip(paths["file_seq"], paths["file_name"], paths["path"], paths["kinds"]):
        files[seq][path] = kinds
        names[seq] = min(name, names[seq]) if seq in names and name else name
    ren: dict = defaultdict(dict)
    for seq, g, c, n in zip(renames["file_seq"], renames["old_path"], renames["new_path"], renames["records"]):
        ren[seq][g, c] = n
    rows = [(names[s], *x) for s in sorted(files) if s - 1 in files for x in compare(files[s - 1], files[s], ren[s])]
    return pd.DataFrame(rows, columns=["file_name", "drift", "field_path", "old_path"])


class Drift:
    """The ingested lines, and the changes between their files."""

    def __init__(self, lines: DataFrame):
        scratch = Scratch(lines.sparkSession, "drift")
        self.ingested = scratch.write(ingest(lines))
        self._paths = scratch.write(file_paths(self.ingested))
        wanted = scratch.write(self._paths.groupBy("feed").applyInPandas(_candidates, "feed string, file_seq int, old_path string, new_path string"))
        self._renames = scratch.write(_renames(wanted, self.ingested))

    def report(self) -> DataFrame:
        """(file_name, drift, field_path, old_path): one row per change against the previous file of the feed."""
        return self._paths.groupBy("feed").cogroup(self._renames.groupBy("feed")).applyInPandas(_report, "file_name string, drift string, field_path string, old_path string")

    def approved(self, user: dict[str, str] = APPROVED) -> dict[str, str]:
        """Names approved by the report's renames and the user; the distinct renames are as few as the feeds' fields."""
        renames = self.report().where("drift = 'renamed'").select("field_path", "old_path").distinct().collect()
        return approvals([(r.field_path, r.old_path) for r in renames], user)

    def samples(self, user: dict[str, str] = APPROVED) -> DataFrame:
        """One consistent table of samples of all files, renamed fields promoted from the rescue column."""
        return promote(self.ingested.where("_status = 'ok'").drop("_paths", "_written"), self.approved(user))


def drift(lines: DataFrame) -> DataFrame:
    return Drift(lines).report()


def samples(lines: DataFrame, user: dict[str, str] = APPROVED) -> DataFrame:
    return Drift(lines).samples(user)
