"""What a plan did: rows that its exchanges wrote, and the names of its operators."""


def walk(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        children = plan.children()
        below = [children.apply(k) for k in range(children.size())]
    for child in below:
        yield from walk(child)


def ran(df):
    """The operators of a table's plan after it has run."""
    rows = df.collect()
    return rows, list(walk(df._jdf.queryExecution().executedPlan()))


def dealt(operators) -> int:
    """Rows that exchanges wrote."""
    return sum(x.metrics().apply("shuffleRecordsWritten").value() for x in operators if x.getClass().getSimpleName() == "ShuffleExchangeExec")
