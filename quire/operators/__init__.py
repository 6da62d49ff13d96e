"""DataFrame operators: ``f(df, ...) -> DataFrame``."""
