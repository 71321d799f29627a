"""Training-data operators: sharding, decontamination, chat formatting, near-duplicate removal, tokenization,
language identification, passage removal, web archives, media columns and toxicity.

Nothing outside this subpackage imports it; ``rivulet.llm.queries`` lists the registered queries.
"""
