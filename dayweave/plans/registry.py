"""All query families, loaded in inventory order."""

from . import views  # noqa: F401
from . import src  # noqa: F401
from . import windows_features  # noqa: F401
from . import timelines  # noqa: F401
from . import statistics  # noqa: F401
from . import metadata  # noqa: F401
from . import insights  # noqa: F401
from . import learning  # noqa: F401
from . import live  # noqa: F401
from .metadata import flagship  # noqa: F401
from .catalog import COVERS, ORACLES, QUERIES  # noqa: F401
