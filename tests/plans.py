"""Physical plans as text."""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan after adaptive execution; runs the query."""
    df._jdf.queryExecution().toRdd().count()
    return plan(df).split("== Initial Plan ==")[0]
