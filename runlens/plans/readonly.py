"""The gate of ``query``: statements may only read."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Kinds of nodes that do more than read: commands and statements (DDL, DML, SET, ...), writes to a
#: folder (neither of both kinds), and programs that rows are piped through.
_REFUSED = ("Command", "ParsedStatement", "InsertIntoDir", "ScriptTransformation")
#: Functions that call methods of the JVM by name.
_REACHING = {"reflect", "java_method", "try_reflect"}


def check_read_only(statement: str, spark: SparkSession) -> None:
    """Refuses statements that do more than read, by the plan of Spark's own parser.

    The whole plan is looked through: children, common table expressions and other
    inner plans, and the plans of subqueries in expressions.
    """
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in _REFUSED]
    tree = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.trees.TreeNode")
    logical = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    inner = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    stack = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while stack:
        node = stack.pop()
        if any(k.isInstance(node) for k in kinds):
            raise ValueError("only queries are accepted; this statement is a command or writes")
        below = [node.children(), node.innerChildren()]
        if logical.isInstance(node):
            below.append(node.expressions())
        elif inner.isInstance(node):
            stack.append(node.plan())
        elif node.getClass().getSimpleName() == "UnresolvedFunction" and node.nameParts().last().lower() in _REACHING:
            raise ValueError("functions that call methods by name are not accepted")
        stack += [x for part in below for k in range(part.size()) if tree.isInstance(x := part.apply(k))]
