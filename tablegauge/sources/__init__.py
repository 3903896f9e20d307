"""Reading tables, catalogues, runs and event logs; writing results."""
