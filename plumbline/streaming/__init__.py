"""Daily activity and account history from streams of events."""

from plumbline.streaming.account_history import keep_history, repair_late
from plumbline.streaming.daily_activity import append_closed_days, daily_activity

__all__ = ["append_closed_days", "daily_activity", "keep_history", "repair_late"]
