"""What several test modules share; not a conftest, of which there may be more than one."""

DATA = "/root/testdata/sf0.001"


def plan(df):
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)
