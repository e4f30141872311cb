"""No streaming operator exists here, on purpose: the work is on finished tables.

The stateless parts (scalar functions, ``tag_rejects``, ``add_shares``, ``hash_holdout``,
``hash_fold``) are plain column expressions and run unchanged on a streaming DataFrame;
``tests/test_streaming.py`` holds them to that.
"""
