"""Column-level building blocks: text, statistics, predicates, word lists."""
