"""Message routing, request parameters and session history."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Routes in order of precedence with the phrases that vote for them.
ROUTES = {
    "forecast_insight": [
        "forecast", "predict", "next week", "next month", "demand",
        "will sell", "revenue next", "stock up", "restock", "how much will",
        "14 day", "7 day", "days ahead", "upcoming",
    ],
    "retail_analyst": [
        "anomaly", "anomalies", "spike", "unusual", "compare", "vs",
        "best selling", "top category", "performance", "trend",
        "which category", "how did", "last month", "2023", "revenue was",
        "highest", "lowest", "sales data",
    ],
    "product_knowledge": [
        "return policy", "refund", "exchange", "warranty",
        "what is", "tell me about", "explain", "how does",
        "restocking", "lead time", "price", "product info",
        "policy", "customer", "loyalty",
    ],
}
DEFAULT_ROUTE = "retail_analyst"
HISTORY_TURNS = 6

# Words naming a category, first match first, and phrases asking for the longer horizon.
CATEGORY_WORDS = {"Beauty": "beauty", "Clothing": "clothing", "Electronics": "electronics"}
LONG_HORIZON = ["14", "two week"]


def _hits(message: Column, phrases: list[str]) -> Column:
    votes = [F.coalesce(message.contains(p).cast("int"), F.lit(0)) for p in phrases]
    return reduce(lambda a, b: a + b, votes, F.lit(0))


def route_messages(
    messages: DataFrame,
    text: str = "text",
    routes: dict[str, list[str]] = ROUTES,
    default: str = DEFAULT_ROUTE,
) -> DataFrame:
    """Add the votes per route and ``agent``: the route with most votes, the earlier one on a tie."""
    lowered = F.lower(text)
    voted = messages.withColumns({f"{name}_score": _hits(lowered, phrases) for name, phrases in routes.items()})
    scores = [F.col(f"{name}_score") for name in routes]
    best = F.greatest(*scores)
    agent = F.when(best == 0, default)
    for name in routes:
        agent = agent.when(F.col(f"{name}_score") == best, name)
    return voted.withColumn("agent", agent)


def reject_empty(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.where(F.length(F.coalesce(F.col(text), F.lit(""))) > 0)


def forecast_params(
    messages: DataFrame,
    text: str = "text",
    category_words: dict[str, str] = CATEGORY_WORDS,
    long_horizon: list[str] = LONG_HORIZON,
) -> DataFrame:
    """One row per message and requested category with the number of days: 14 if asked for, else 7."""
    lowered = F.lower(text)
    everything = F.array(*map(F.lit, category_words))
    named = F.lit(None)
    for category, word in reversed(category_words.items()):
        named = F.when(lowered.contains(word), F.array(F.lit(category))).otherwise(named)
    days = F.when(_hits(lowered, long_horizon) > 0, 14).otherwise(7)
    return messages.withColumns({"days": days, "product_category": F.explode(F.coalesce(named, everything))})


def session_history(
    messages: DataFrame, session: str = "conv_id", turn: str = "turn", turns: int = HISTORY_TURNS
) -> DataFrame:
    """The last messages of each session (two per turn) with the number of turns they make up.

    Each task keeps at most that many rows per session before the shuffle, so a session
    with very many messages is no heavier than another.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    kept = messages.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= 2 * turns)
    size = F.count(F.lit(1)).over(Window.partitionBy(session))
    return kept.withColumn("conversation_turns", F.floor(size / 2).cast("int")).drop("_age")


def clear_sessions(messages: DataFrame, cleared: DataFrame, session: str = "conv_id") -> DataFrame:
    """Messages of the sessions not listed in ``cleared``."""
    return messages.join(cleared.select(session).distinct(), session, "left_anti")
