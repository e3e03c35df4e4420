"""Makes this folder's helpers importable and offers its fixtures."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import odd_docs  # noqa: E402, F401
