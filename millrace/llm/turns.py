"""Who speaks in a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names under which a speaker appears.
USER = ("user", "human", "prompter")
ASSISTANT = ("assistant", "gpt", "model", "bot")
SYSTEM = ("system",)


def speaker(role: Column) -> Column:
    """'user', 'assistant' or 'system' for a role under any of its names, in any case, with blanks around; else null."""
    r = F.lower(F.regexp_replace(role, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    return F.when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant").when(r.isin(*SYSTEM), "system")
