"""Operations of a training-data pipeline (deduplication, mixing, archives, classifiers, search).

Nothing outside this subpackage imports it; ``lodestone.llm.queries`` lists its queries and SQL.
"""
