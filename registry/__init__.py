"""All registered queries; importing the package fills the registry."""

from registry import alignment, devices, features, inputs, models, streams, training  # noqa: F401
from registry.common import ORACLES, QUERIES  # noqa: F401
