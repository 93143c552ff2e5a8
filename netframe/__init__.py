"""netframe: chip-layout and netlist analytics written as Spark DataFrame jobs."""
