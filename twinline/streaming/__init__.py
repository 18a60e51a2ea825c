"""Nothing is built here: the work this library covers has no streams.

The column functions of ``twinline.functions`` hold no state, so they also run on a streaming
DataFrame; ``tests/test_streaming.py`` shows it.
"""
