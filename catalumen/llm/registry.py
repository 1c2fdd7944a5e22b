"""The subpackage's query modules."""

MODULES = [
    "catalumen.llm.pictures",
    "catalumen.llm.survivors",
    "catalumen.llm.history",
    "catalumen.llm.seen",
    "catalumen.llm.tokens",
    "catalumen.llm.mixture",
    "catalumen.llm.abuse",
]
