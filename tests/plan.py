"""Physical plans as text."""


def physical(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def simple(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
