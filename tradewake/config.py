"""Names and constants shared by the jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Topics that the services around the warehouse read and write.
TOPIC_LAUNCH = "TOPIC_START"
TOPIC_EVENT = "TOPIC_EVENT"
TOPIC_ORDER = "TOPIC_ORDER_INFO"
TOPIC_USER = "TOPIC_USER_INFO"
TOPIC_ORDER_LINE = "TOPIC_ORDER_DETAIL_INFO"

# Labels shown on the dashboard cards and in the search breakdown.
CARD_NAMES = {"dau": "新增日活", "new_mid": "新增设备", "order_amount": "新增交易额"}
AGE_TITLE = "用户年龄占比"
AGE_UNDER_20 = "20岁以下"
AGE_20_TO_30 = "20岁到30岁"
AGE_FROM_30 = "30岁及30岁以上"
GENDER_TITLE = "用户性别占比"
GENDER_MALE = "男"
GENDER_FEMALE = "女"

# Windows, time limits and list sizes of the jobs.
TRIGGER = "5 seconds"
ALERT_WINDOW_SECONDS = 300
ALERT_SLIDE_SECONDS = 5
ALERT_ACCOUNTS = 3
LINE_AFTER_ORDER_SECONDS = 100
LINE_BEFORE_ORDER_SECONDS = 300
AGE_BUCKETS = 100
GENDER_BUCKETS = 10


@dataclass(frozen=True)
class JobPaths:
    """Where one deployment keeps its tables, checkpoints and raw logs.

    All three have to be on storage that every executor sees.
    """

    tables: str
    checkpoints: str
    raw_logs: str

    def table(self, name: str) -> str:
        return f"{self.tables.rstrip('/')}/{name}"

    def checkpoint(self, job: str) -> str:
        return f"{self.checkpoints.rstrip('/')}/{job}"
