"""All registered queries, one module per operator family."""

from landtally.plans import fields, intervals, relations, samples, scores, space  # noqa: F401
from landtally.plans.registry import ORACLES, QUERIES  # noqa: F401
