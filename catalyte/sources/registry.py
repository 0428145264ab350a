"""The registry of dataset versions: which there are, their validation, and the one that is active.

Rows and the active version change together, as one new version of the registry's log, so a reader sees
one active version or none, and of two activations at the same time one is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest
from .commits import Commits
from .csv_contract import read_dataset, write_dataset

SCHEMA = "dataset_id string, created_at string, is_active boolean, validation_status string, activation_blocked boolean"


class Registry:
    """Datasets below ``root``: their rows in ``images``, the log in ``registry``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/registry")

    def state(self) -> tuple[int, dict]:
        version = self.commits.latest()
        return version, self.commits.read(version) if version else {"active": None, "datasets": {}}

    def datasets(self) -> DataFrame:
        """One row a dataset."""
        _, state = self.state()
        rows = [(k, d["created_at"], k == state["active"], d["validation_status"], d["activation_blocked"]) for k, d in sorted(state["datasets"].items())]
        return self.spark.createDataFrame(rows, SCHEMA)

    def images(self, dataset_id: str | None = None) -> DataFrame:
        """The rows of a dataset, of the active one if none is named."""
        dataset_id = dataset_id or self.state()[1]["active"]
        if dataset_id is None:
            raise LookupError("no dataset is active")
        return read_dataset(self.spark, f"{self.root}/images", dataset_id)

    def _change(self, how: Callable[[dict], None]) -> dict:
        def changed(state: dict) -> dict:
            how(state)
            return state

        return self.commits.change(changed, {"active": None, "datasets": {}})

    def register(self, images: DataFrame, dataset_id: str, *, blocked: bool = False, now: datetime | None = None) -> None:
        """Write a dataset's rows, then enter it; until then no reader knows of it. The active one cannot be replaced."""
        if self.state()[1]["active"] == dataset_id:
            raise ValueError("the active version cannot be replaced")
        write_dataset(images, f"{self.root}/images")
        at = (now or datetime.now(timezone.utc)).isoformat()

        def enter(state: dict) -> None:
            if state["active"] == dataset_id:
                raise ValueError("the active version cannot be replaced")
            state["datasets"][dataset_id] = {"created_at": at, "validation_status": "pending", "activation_blocked": blocked}

        self._change(enter)

    def activate(self, dataset_id: str, *, expected: int | None = None) -> int:
        """Make a dataset the active one and archive the one before; returns the registry's version.

        Refused (``ValueError``) if it is unknown or blocked or one of its batches has several items. The gates
        are checked against one version of the registry (``expected``, or the newest), and the
        change is made from that one alone: ``Conflict`` if anyone changed it meanwhile.
        """
        version, state = self.state() if expected is None else (expected, self.commits.read(expected))
        found = state["datasets"].get(dataset_id)
        if found is None or found["activation_blocked"]:
            raise ValueError(f"{dataset_id} cannot be activated")
        if ingest.collisions(self.images(dataset_id), "batch_id", "company_stone_id").limit(1).count():
            raise ValueError(f"{dataset_id} has batches with more than one item")
        if state["active"] not in (None, dataset_id):
            state["datasets"][state["active"]]["validation_status"] = "archived"
        found["validation_status"], state["active"] = "validated", dataset_id
        return self.commits.put(version + 1, state)

    def delete(self, dataset_id: str) -> None:
        """Forget a dataset, then delete its rows."""

        def forget(state: dict) -> None:
            if state["active"] == dataset_id:
                raise ValueError("the active version cannot be deleted")
            state["datasets"].pop(dataset_id, None)

        self._change(forget)
        self.commits.store.delete(self.commits.path(f"{self.root}/images/dataset_id={dataset_id}"), True)
