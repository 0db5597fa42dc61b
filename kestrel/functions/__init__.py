from kestrel.functions.scalars import *  # noqa: F401,F403
from kestrel.functions.exact import *  # noqa: F401,F403
