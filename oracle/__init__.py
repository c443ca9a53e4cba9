"""SQL for DuckDB that must give the same rows as the registered queries."""

from .blocks import BLOCKS
from .loan_book import REPORTS
from .models import MODELS
from .returns import BACKTESTS, PANELS

ORACLE: dict[str, str] = {**REPORTS, **BLOCKS, **PANELS, **BACKTESTS, **MODELS}
