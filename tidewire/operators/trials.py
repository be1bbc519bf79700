"""A queue of trials that several driver threads, and several drivers, work through together.

A ledger folder holds ``claims/<trial>/<token>`` and ``results/<trial>-<attempt>.json``. A trial is claimed by writing a
token and then listing the trial's claims: whoever is alone owns it, anyone else takes the own token back. A driver that
sees itself alone was there before any later one listed, so no trial has two owners. A finished trial, failed ones
too, leaves a result; claims without one are trials that run, or were lost with their driver and expire.
"""

from __future__ import annotations

import json
import random
import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.commit import Store

RUNNING, COMPLETE, FAIL = "RUNNING", "COMPLETE", "FAIL"
TRIAL_SCHEMA = (
    "number int, state string, value double, val_auc double, val_loss double, params map<string,string>, "
    "attempt int, owner string, started timestamp_ntz, ended timestamp_ntz, error string"
)


def _now() -> str:
    return f"{datetime.now(timezone.utc).replace(tzinfo=None):%Y-%m-%dT%H:%M:%S.%f}"


class TrialLedger:
    """Claims and results below ``path``, a folder that all drivers reach."""

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.store, self.owner = Store(spark, self.path), owner or uuid.uuid4().hex
        self.rng = random.Random()

    def results(self) -> dict[int, tuple[int, dict]]:
        """Newest attempt and result of each finished trial; one small file each."""
        found: dict[int, tuple[int, dict]] = {}
        for name, _ in self.store.names(f"{self.path}/results"):
            if name.endswith(".json") and not name.startswith("_"):
                number, attempt = map(int, name.removesuffix(".json").split("-"))
                if attempt >= found.get(number, (0, {}))[0]:
                    found[number] = (attempt, json.loads(self.store.read(f"{self.path}/results/{name}")))
        return found

    def claims(self, number: int) -> list[str]:
        return [n for n, _ in self.store.names(f"{self.path}/claims/{number}") if not n.startswith(".")]

    def claim(self, number: int, attempt: int) -> str | None:
        """A token if the trial is now this ledger's alone, else None."""
        if self.claims(number):
            return None
        token = f"{self.owner}-{uuid.uuid4().hex}"
        where = f"{self.path}/claims/{number}/{token}"
        self.store.write(where, json.dumps({"owner": self.owner, "attempt": attempt, "started": _now()}))
        if self.claims(number) == [token] and attempt not in self._attempts(number):
            return token
        self.store.delete(where)
        return None

    def _attempts(self, number: int) -> set[int]:
        names = [n for n, _ in self.store.names(f"{self.path}/results") if n.startswith(f"{number}-")]
        return {int(n.removesuffix(".json").split("-")[1]) for n in names}

    def finish(self, number: int, attempt: int, token: str | None, row: dict) -> None:
        """The result under its final name first, then the claim goes."""
        draft = f"{self.path}/results/_{uuid.uuid4().hex}"
        self.store.write(draft, json.dumps({"number": number, "attempt": attempt, **row}))
        if not self.store.rename(draft, f"{self.path}/results/{number}-{attempt}.json"):
            self.store.delete(draft)
        if token:
            self.store.delete(f"{self.path}/claims/{number}/{token}")

    def running(self) -> list[dict]:
        out = []
        for name, _ in self.store.names(f"{self.path}/claims"):
            for token in self.claims(int(name)):
                claim = json.loads(self.store.read(f"{self.path}/claims/{name}/{token}"))
                out.append({"number": int(name), "token": token, **claim})
        return out

    def expire(self, seconds: float) -> int:
        """Trials claimed longer than ``seconds`` ago count as failed, and may be claimed anew; returns how many."""
        limit = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(seconds=seconds)
        lost = [r for r in self.running() if datetime.fromisoformat(r["started"]) < limit]
        for r in lost:
            row = {"state": FAIL, "owner": r["owner"], "started": r["started"], "ended": _now(), "error": "claim expired"}
            self.finish(r["number"], r["attempt"], r["token"], row)
        return len(lost)

    def table(self) -> DataFrame:
        """One row per trial that was begun: its newest result, or RUNNING."""
        done = self.results()
        rows = [r for _, r in done.values()]
        rows += [{**r, "state": RUNNING} for r in self.running() if r["attempt"] > done.get(r["number"], (0, {}))[0]]
        names = [f.split()[0] for f in TRIAL_SCHEMA.split(", ")]
        cells = []
        for r in rows:
            r = {**r, **{k: datetime.fromisoformat(r[k]) if r.get(k) else None for k in ("started", "ended")}}
            cells.append(tuple(r.get(n) for n in names))
        return self.spark.createDataFrame(cells, TRIAL_SCHEMA)


Objective = Callable[[dict], "dict | float"]


def run_trials(
    spark: SparkSession,
    path: str,
    points: Sequence[dict],
    objective: Objective,
    parallelism: int = 4,
    attempts: int = 1,
    expire_after: float | None = None,
    owner: str | None = None,
) -> DataFrame:
    """Evaluate all points that have no result yet and return the table of trials.

    Trial n has the parameters ``points[n]``. ``objective`` gives its value, or a dict with ``value`` and, if at hand,
    ``val_auc`` and ``val_loss``; an exception makes the trial FAIL and the others go on. A failed trial is tried
    ``attempts`` times in all. ``parallelism`` driver threads submit Spark jobs, each in a scheduler pool of its own, so
    that with ``spark.scheduler.mode=FAIR`` no trial waits for another's tasks. Another driver with the same ``path``
    takes other trials; those it still runs when this one is done are RUNNING in the table.
    """
    ledger = TrialLedger(spark, path, owner)
    if expire_after is not None:
        ledger.expire(expire_after)
    lock, ours = threading.Lock(), set()

    def next_trial() -> tuple[int, int, str] | None:
        with lock:  # threads of this driver ask one after another
            done = ledger.results()
            for number in range(len(points)):
                attempt, result = done.get(number, (0, {}))
                if number in ours or result.get("state") == COMPLETE or attempt >= attempts:
                    continue
                token = ledger.claim(number, attempt + 1)
                if token:
                    ours.add(number)
                    return number, attempt + 1, token
        return None

    def work(slot: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{slot}")
        try:
            while (taken := next_trial()) is not None:
                number, attempt, token = taken
                row = {"params": {k: str(v) for k, v in points[number].items()}, "owner": ledger.owner, "started": _now()}
                try:
                    found = objective(points[number])
                    row.update(found if isinstance(found, dict) else {"value": float(found)}, state=COMPLETE)
                except Exception as error:  # noqa: BLE001  the trial's failure is its result
                    row.update(state=FAIL, error=f"{type(error).__name__}: {error}"[:500])
                ledger.finish(number, attempt, token, {**row, "ended": _now()})
                with lock:
                    ours.discard(number)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for future in [pool.submit(inheritable_thread_target(spark)(work), i) for i in range(parallelism)]:
            future.result()
    return ledger.table()


def frames_by_mode(make: Callable[[str], tuple[DataFrame, ...]]) -> Callable[[str], tuple[DataFrame, ...]]:
    """``make`` called once per feature mode, whichever thread asks first; others of that mode wait for it."""
    guard, locks, made = threading.Lock(), {}, {}

    def get(mode: str) -> tuple[DataFrame, ...]:
        with guard:
            lock = locks.setdefault(mode, threading.Lock())
        with lock:
            if mode not in made:
                made[mode] = make(mode)
            return made[mode]

    return get


def validation_scores(predictions: DataFrame) -> dict:
    """Accuracy as the value, with the exact AUC and the mean logistic loss, of ``label``, ``prediction``, ``probability``."""
    from tidewire.operators import metrics

    p = F.greatest(F.least("probability", F.lit(1 - 1e-12)), F.lit(1e-12))
    scored = predictions.withColumn("z", F.log(p / (1 - p)))
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    row = scored.agg(hit.alias("hit"), F.avg(metrics.logit_loss("label", "z")).alias("loss")).first()
    return {"value": row["hit"], "val_auc": metrics.auc_or_half(predictions), "val_loss": row["loss"]}
