"""Commerce review on Spark: retail KPIs, health checks and review documents."""

from tallybrook.ledger import Ledger

__all__ = ["Ledger"]
