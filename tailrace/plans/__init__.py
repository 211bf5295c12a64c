"""The core queries: importing this package fills the registry in ``core``."""

from tailrace.plans import copies, evaluation, labelling, relational, texts, streams  # noqa: F401
