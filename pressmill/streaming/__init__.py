"""Use with Structured Streaming.

No operator here keeps streaming state.  Row-local operators (everything in
``pressmill.functions`` and the filters of ``pressmill.operators.links`` and
``pressmill.operators.review``) contain no aggregate, window or sort, so they
can be applied to a streaming DataFrame as they are; de-duplication, ranking
and reporting belong in ``foreachBatch`` against the stored tables.
"""
