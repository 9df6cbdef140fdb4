"""All queries of this folder."""

from __future__ import annotations

from matchbook.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13  # noqa: F401
from matchbook.llm.base import ORACLES, QUERIES  # noqa: F401
