"""Refusals.  Raised on the driver while planning where that is possible, else from within the plan."""


class IngestSourceError(Exception):
    """A message source that can't be read: ``category`` is missing_source or zero_byte_source."""

    def __init__(self, category: str, detail: str):
        super().__init__(f"{category}: {detail}")
        self.category, self.detail = category, detail


class LeakError(Exception):
    """A column that must not reach a model."""


class TrainOnlyError(Exception):
    """A fit on anything but eligible training rows."""


class SplitSpanError(Exception):
    """Readings that don't span their split exactly, or a span that is no whole number of windows."""


class SplitOverlapError(Exception):
    """Overlapping, empty or inverted splits."""


class InputError(Exception):
    """Windows, labels or strata that can't be scored."""


class PoolingError(Exception):
    """Counts pooled over a test split."""


class GeneratorError(Exception):
    """A generator configuration that can't be met."""


class LockedSeedsError(GeneratorError):
    """Seeds that are reserved for one evaluation."""


class SplitTableError(GeneratorError):
    """A split table that contradicts itself."""


class NonFiniteEligibleInputError(Exception):
    """A value that isn't finite where only finite ones have a meaning."""


class InsufficientBaselineError(Exception):
    """Fewer eligible windows than a baseline needs."""


class NonFiniteBaselineError(Exception):
    """A baseline score or threshold that isn't finite."""


class MissingFitBoundaryError(Exception):
    """A baseline without the window at which its fit ended."""


class SelectionIntegrityError(Exception):
    """A selection that changed after it was made."""


class ArtifactExistsError(Exception):
    """A run artifact that would be overwritten."""
