"""rarefield: a PySpark-native engine for grain-, voxel- and step-scale materials tables.

Every operator takes and returns DataFrames (or Columns) so that Catalyst sees
one declarative plan.  Column names are parameters throughout.
"""

__version__ = "0.1.0"
