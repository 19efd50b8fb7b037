"""Sessions of a conversation and their messages as tables of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

ROLES = ["user", "assistant", "system"]


class Sessions:
    def __init__(self, store: Store):
        self.store = store

    def start(self, rows: DataFrame) -> None:
        """Add sessions (session_id, name, codebase, started); one without a name is named after its start."""
        name = F.coalesce("name", F.concat(F.lit("Chat Session - "), F.date_format("started", "yyyy-MM-dd HH:mm:ss")))
        self.store.append("sessions", rows.select("session_id", name.alias("name"), "codebase", "started"), "session_id")

    def add(self, rows: DataFrame) -> None:
        """Append messages (message_id, session_id, role, content, metadata, at); other roles and unknown sessions are left out."""
        known = self.store.load("sessions").select("session_id")
        good = rows.where(F.col("role").isin(*ROLES) & F.col("content").isNotNull()).join(known, "session_id", "left_semi")
        self.store.append("messages", good.select("message_id", "session_id", "role", "content", "metadata", "at"), "message_id")

    def messages(self, session_id) -> DataFrame:
        return self.store.load("messages").where(F.col("session_id") == session_id).orderBy("at", "message_id")

    def recent(self, n: int = 10) -> DataFrame:
        """The sessions with the newest messages."""
        last = self.store.load("messages").groupBy("session_id").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
        return self.store.load("sessions").join(last, "session_id", "left").orderBy(F.desc_nulls_last("last"), "session_id").limit(n)

    def delete(self, session_id) -> None:
        for table, key in (("messages", "message_id"), ("sessions", "session_id")):
            self.store.delete_files(table, self.store.load(table).where(F.col("session_id") == session_id), key)
