"""Incremental fits over streams: every micro-batch is merged into a fitted object."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from orrery.core import Context, Dataset, Fitted, Spec
from orrery.errors import UnsupportedDataError


class StreamingFit:
    """``partial_fit`` per micro-batch. A batch that is delivered again is merged once.

    state: called with (batch id, fitted object) after each merge, to save it beside the stream's checkpoint.
    """

    def __init__(self, spec: Spec, features: Sequence[str], target: str | None = None, weight: str | None = None, id: str | None = None, context: Context | None = None, state: Callable[[int, Fitted], None] | None = None):
        if not spec.capabilities().partial_fit:
            raise UnsupportedDataError(f"{type(spec).__name__} cannot be fitted in parts")
        self.spec, self.roles, self.context, self.state = spec, (tuple(features), target, weight, id), context or Context(), state
        self.fitted: Fitted | None = None
        self.last_batch = -1

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch or batch.isEmpty():
            return
        features, target, weight, id = self.roles
        self.fitted = self.spec.partial_fit(self.fitted, Dataset(batch, features, target, weight, id), self.context.derive("batch", batch_id))
        self.last_batch = batch_id
        if self.state:
            self.state(batch_id, self.fitted)

    def run(self, stream: DataFrame, checkpoint: str) -> Fitted | None:
        """Merges all that is available now and returns the fitted object."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.fitted
