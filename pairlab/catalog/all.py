"""Import every catalog module so that all queries are registered."""

from pairlab.catalog import prep_q  # noqa: F401
from pairlab.catalog import metrics_q  # noqa: F401
from pairlab.catalog import explain_q  # noqa: F401
from pairlab.catalog import gating_q  # noqa: F401
from pairlab.catalog import parse_q  # noqa: F401
from pairlab.catalog import io_q  # noqa: F401
from pairlab.catalog import profile_q  # noqa: F401
from pairlab.catalog import misc_q  # noqa: F401
from pairlab.catalog import core_q  # noqa: F401
