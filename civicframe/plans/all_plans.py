"""Import every plan module so each registers itself."""

from civicframe.plans import activity  # noqa: F401
from civicframe.plans import orders  # noqa: F401
from civicframe.plans import geography  # noqa: F401
from civicframe.plans import notes  # noqa: F401
from civicframe.plans import documents  # noqa: F401
from civicframe.plans import boundaries  # noqa: F401
from civicframe.plans import formats  # noqa: F401
from civicframe.plans import storage  # noqa: F401
from civicframe.plans import sleep  # noqa: F401
from civicframe.plans import chas  # noqa: F401
from civicframe.plans import everyday  # noqa: F401
from civicframe.plans import note_steps  # noqa: F401
from civicframe.plans import intake  # noqa: F401
