"""pulse — media and claims intelligence on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns); nothing is collected to the driver.  Catalyst plans the work.
"""

__version__ = "0.1.0"
