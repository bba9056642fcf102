"""Training-data operators over ``documents``, ``pages``, ``benchmark`` and ``labels``.

Nothing outside this subpackage imports it; ``queries.py`` lists what it registers.
"""
