"""Writers: the partitioned store and exports."""
