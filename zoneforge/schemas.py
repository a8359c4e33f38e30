"""Schemas of the stored tables."""

STRUCTURE = "struct_id long, pdb_id string, model_id string, split string"
ASSEMBLY = "assembly_id long, struct_id long, pdb_id string"
ATOMS = (
    "assembly_id long, atom_id long, subchain_id string, symmetry_mate int, chain_id string, entity_id string, comp_id string, "
    "seq_id int, atom_name string, element string, x double, y double, z double, occupancy double, is_polymer boolean, "
    "polymer_label int, cath_label int, out_of_bounds boolean"
)
ZONE = "zone_id long, assembly_id long, center struct<x:double,y:double,z:double>"
SUBCHAIN = "zone_id long, subchain_id string, symmetry_mate int"
SUBCHAIN_PAIR = "zone_id long, subchain_id_1 string, symmetry_mate_1 int, subchain_id_2 string, symmetry_mate_2 int"
NEIGHBOR = "neighbor_id int, dx double, dy double, dz double"
ZONE_NEIGHBOR = "zone_id long, neighbor_id int"
CURRICULUM = "zone_id long, random_seed long, difficulty double"
METADATA = "key string, value string, encoding string"
DOMAINS = "pdb_id string, chain_id string, domain_id int, c int, a int, t int, h int"
RANGES = "pdb_id string, chain_id string, domain_id int, seq_ids array<int>"
CLUSTERS = "pdb_id string, cluster string"
EVAL_LOG = "i long, y_true int, y_guess string, noise_distance double, noise_angle double"
