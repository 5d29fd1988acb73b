"""stoa: analytics over indoor 3-D scenes, robots and text, as plain Spark jobs.

``operators`` hold DataFrame-to-DataFrame functions, ``functions`` Column
expressions, ``sources`` readers and writers, ``plans`` the registered queries
with their SQL twins, ``streaming`` the stateful stream operators.
"""
