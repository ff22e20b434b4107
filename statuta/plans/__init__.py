"""Query plans: operators bound to the driver's tables, each with its SQL form where there is one."""
