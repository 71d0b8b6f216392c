"""Operations for building language-model training data, ten in all.

Nothing outside this package imports it; ``textmill.llm.queries`` lists what it registers.
"""
