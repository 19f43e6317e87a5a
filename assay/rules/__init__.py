"""Rules as data: their definitions, the gate that admits them, and the shipped library."""
