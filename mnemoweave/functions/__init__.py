"""Column helpers: every scalar of the engine as built-in expressions."""

from mnemoweave.functions.json_repair import *  # noqa: F403
from mnemoweave.functions.scores import *  # noqa: F403
from mnemoweave.functions.text import *  # noqa: F403
from mnemoweave.functions.time import *  # noqa: F403
